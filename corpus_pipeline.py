"""From documents to a mixture: language ID, near-duplicates, benchmark passages, personal data, mixing.

Each stage takes and returns the columns of documents, but for the last, which adds what the mixture says of a
document: its tokens, the weight of its source, its block and its copies.  A stage's rows are written to the shared
folder and read again before the next one begins; the rows of the stage before it are deleted then, and the last ones when
the application ends.

Defined results: every row is judged by itself, also with a null or repeated doc_id; equal rows are near-duplicates, so
one of them stays; null, empty and letterless texts go at the first stage; a null lang does not train, and without any
lang no language is known and no document stays; an empty table passes through as one; very long texts are read whole;
further columns of any name come along, but n_tokens, weight, block and copies make way for those of the last stage.
"""

from __future__ import annotations

import uuid

from tessera.llm import decontam, langid, mixing, pii, simhash
from tessera.llm.common import removed, shared_folder, table, written


def language_id(spark, docs, sf_dir):
    """Drops documents without a letter or in no language of the corpus."""
    return langid.keep_known(docs)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Drops documents with benchmark passages, by the rule of op8."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Puts surrogates in place of personal data."""
    return pii.replaced(docs)


def mixture(spark, docs, sf_dir):
    """The documents that the mixture takes at least once, with n_tokens, weight, block and copies."""
    return mixing.with_copies(docs).filter("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
#: SQL can express neither the language model nor fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what passes from one to the next is in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"{folder}/{i}")
            if i:
                removed(spark, f"{folder}/{i - 1}")
    return docs
