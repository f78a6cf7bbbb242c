"""Odd documents, and plain readings of the contracts."""

from __future__ import annotations

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, sequence_id long, _row long, _mix_whole long, whole long, last_key string, size long, part int, rank int, score double"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box a jug of warm liquor near a green hill"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n \x0b ", None, None, 5),
    (4, PROSE, "en", "b", 100),
    (5, PROSE + " again", "en", "b", 100),
    (5, PROSE + " again", "en", "b", 100),
    (6, "lorem ipsum dolor sit amet " * 12_000, "la", "c", 1),
    (None, PROSE.upper(), "en", "b", 100),
    (None, None, None, None, None),
    (7, "naïve Ünïcode 😀😀 <|endoftext|> end\n\n  two  spaces　wide\xa0hard", "de", "\U0001f600", 3),
    (8, "Released under the MIT License. Apache-License apache\nlicense; General Public License general public license", "en", "c", 9),
    (9, "one two", "en", "b", 7),
    (10, "one two three", "en", "b", 13),
    (-3, "x\nx\nx\ny\n\n\ny\n" + "a b c d e f g " * 9, "en", None, 12),
]


def odd_docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "k", 6, 7, 8, 0.5) for r in ODD], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(BPE)


def texts(spark, folder: str) -> list[tuple]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def sql_rows(folder: str, sql: str, names: list[str], **extra) -> list[tuple]:
    """Rows of DuckDB over the tables of a folder, columns in the order of names."""
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        if folder:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, frame in extra.items():
        c.register("_in", frame)
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM _in")
    got = c.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    return got


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r])
