"""op9: SentencePiece ids of all documents, and whether they decode to the text."""

from weftwork.llm import piece_encoding
from weftwork.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_piece_encoding(spark, sf_dir):
    return piece_encoding.digests(table(spark, sf_dir, "documents"), vocabulary())
