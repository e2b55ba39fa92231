"""Language identification by compression.

Every language has a raw-content dictionary of bounded size, made of training texts. A whole text is encoded with each dictionary,
and the language with the smallest result is chosen; a narrow margin to the second is reported as rejected. Long
texts are encoded in pieces, so that the dictionary stays in reach all the way and not the text's own beginning.

Text and dictionaries are lower-cased and freed of ASCII punctuation and digits. Null texts and texts without a letter are `und`
with score 0. Ties go to the first language in order. Without training rows everything is `und`.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.frames import id_bucket, map_batches

SAMPLES = 80            # training texts for each language, about
SAMPLE_CHARS = 1_500    # letters of each, for the dictionary, from a place drawn by the id
LEVEL = 3
PIECE = 16 * 2**10
NARROW = 0.01           # margin below which a decision is rejected
UNKNOWN = "und"

_SPACES = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_SPACES).split())


def learn_dictionaries(docs: DataFrame, samples: int = SAMPLES) -> dict[str, bytes]:
    """Dictionary content of each language, from about `samples` rows of each, chosen by a digest of the id.

    Only the rows whose crc32(doc_id) leaves a remainder other than 0 by 5 are learned from. What is no letter is taken out of a sampled text
    first, then a stretch of SAMPLE_CHARS is taken from a place anywhere in it, so digits or markup at its beginning do no harm. The
    driver gets at most about samples x SAMPLE_CHARS characters of each language.
    """
    known = docs.filter((id_bucket("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row for each language
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sampled = known.join(F.broadcast(counts), "lang").filter(draw < F.lit(samples) / F.col("n"))
    letters = sampled.select("lang", "doc_id", F.trim(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " ")).alias("text"))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit("stretch"), "doc_id", "text"), spare.cast("bigint") + 1).cast("int") + 1
    rows = letters.select("lang", "doc_id", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        texts.setdefault(row["lang"], []).append(plain(row["text"]))
    return {lang: b" ".join(parts) for lang, parts in texts.items() if any(parts)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin) of one whole text."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        data = plain(text)
        sizes = [sum(len(c.compress(data[i:i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        return self.languages[best], margin / (margin + 0.05), margin


def classify_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    made: list[Classifier] = []

    def step(batch: pa.RecordBatch) -> dict:
        made[:] = made or [Classifier(dictionaries)]
        found = [made[0].classify(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()),
                "rejected": pa.array([f[2] < NARROW for f in found], pa.bool_())}

    return map_batches(docs.select("doc_id", "text"), step, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
