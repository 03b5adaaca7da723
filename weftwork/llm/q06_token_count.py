"""op6: byte-level tokens of all documents, counted by separator scans of token files."""

from weftwork.llm import token_count
from weftwork.llm.common import table


def op6_token_count(spark, sf_dir):
    return token_count.document_tokens(table(spark, sf_dir, "documents"))


ORACLE = "select doc_id, strlen(coalesce(text, ''))::bigint as n_tokens from documents"
