"""Secrets in whole texts: fixed patterns, and strings that a tokenizer finds hard to shorten.

A random string needs a token for every one or two characters, while words and
names of any language that a vocabulary knows need one for three or more. A run
of at least ``LEAST`` characters that mixes letters and digits and stays under
``MOST_PER_TOKEN`` characters for each token is reported as ``random``, unless
it is a digest of known length, a UUID, or an identifier made of words.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
LEAST, MOST_PER_TOKEN = 20, 2.2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
# Lengths of hexadecimal digests in wide use (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
_DIGESTS = (32, 40, 56, 64, 96, 128)
_ONLY_HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
_NAME = re.compile(r"([A-Za-z]{2,}|[0-9]{1,4})([/_=+-]+([A-Za-z]{2,}|[0-9]{1,4}))*")


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _known(run: str) -> bool:
    """A digest, a UUID, or words and short numbers with joints."""
    return bool(len(run) in _DIGESTS and _ONLY_HEX.fullmatch(run) or _UUID.fullmatch(run) or _NAME.fullmatch(run))


def spans(text: str, encoding: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` in code points, by start and then kind."""
    found = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    base = sorted(found)
    for m in _RUN.finditer(text):
        run = m[0]
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or _known(run):
            continue
        if any(a < m.end() and m.start() < b for a, b, _ in base):
            continue
        if len(run) < MOST_PER_TOKEN * len(encoding.encode_ordinary(run)):
            found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def _scan(path: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in ta.slices(batches, "text"):
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans(text or "", encoding)]
                for text in batch.column("text").to_pylist()
            ]
            yield batch.append_column("spans", pa.array(rows, kind))

    return run


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``spans``, an array of ``kind, start, end`` (code points, end exclusive).

    One scan without a shuffle; all columns and rows stay as they are, repeated
    rows included. A null or empty text has no spans. A column named ``spans``
    is replaced. An empty table gives an empty result. Base matches are
    non-overlapping within their kind and may overlap those of other kinds; a
    ``random`` span overlaps no base span. ``vocabulary`` is a tiktoken file
    that every executor can read.
    """
    docs = docs.drop("spans").withColumn("text", F.col("text").cast("string"))
    schema = docs.withColumn("spans", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema
    return docs.mapInArrow(_scan(vocabulary or public_tokenizers.path(VOCABULARY)), schema)


def mask_secrets(docs: DataFrame, vocabulary: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mask``, overlapping ones by one mask."""
    names = docs.columns
    found = find_secrets(docs, vocabulary)

    def step(state, span):
        cut = F.greatest(span["start"], state["at"])
        piece = F.when(span["start"] >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, cut - state["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], piece).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = F.aggregate("spans", start, step)
    masked = F.concat(end["out"], F.substring(F.col("text"), end["at"] + 1, F.length("text")))
    return found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).select(names)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def joined(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return find_secrets(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
