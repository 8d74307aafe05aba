"""Query of the main-text extraction."""

from .registry import case, table
from .wrapper import extract


@case("op11_main_text")
def op11_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
