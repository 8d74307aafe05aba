"""Query of the token store."""

from ..session import shared_path
from .huffman import digest, write_store
from .registry import case, table, tokenizer_path


@case("op6_token_store")
def op6_token_store(spark, sf_dir):
    path = write_store(table(spark, sf_dir, "documents"), tokenizer_path(), shared_path(spark, "token-store"))
    return digest(spark, path)
