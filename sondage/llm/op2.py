"""Query of the packing operator."""

from .packing import pack
from .registry import case, table, tokenizer_path


@case("op2_packing")
def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
