"""Query of the token counts."""

from .registry import case, table, tokenizer_path
from .token_counts import count_by_section


@case("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return count_by_section(table(spark, sf_dir, "documents"), tokenizer_path())
