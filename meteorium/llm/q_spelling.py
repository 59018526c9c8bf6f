"""Query of the spelling variants; crc32 has no SQL form, so the tests hold it against brute force."""

from . import spelling
from .common import table


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": (op13_spelling_variants, None)}
