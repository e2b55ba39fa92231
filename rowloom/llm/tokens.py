"""Token counts with a digest cache.

A text is normalised (null is empty; U+2581, which the tokenizer reads as a space, is a space) and digested; (content digest, tokenizer
digest) is the key of the cache, a Parquet table in a shared folder. Documents are joined to it by key, one text of
every missing key is encoded, and the new counts are appended. Digests move, texts do not: the documents
that need not be encoded are told by an id list that is broadcast only within the size bound.

Encoding counts what the library returns for the whole text. Where no piece of the vocabulary holds a space behind another character,
no merge crosses such a place, so counts of the stretches between them add up; each worker remembers the counts of
stretches it has seen. With other vocabularies whole texts are encoded.

Null and empty texts have no token. Repeated rows each keep their row and share one count.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.frames import join_counted, map_batches, match_rows, row_key
from rowloom.session import scratch_path, write_stage

LIMIT = 4096
REMEMBERED = 1_000_000      # stretches a worker remembers
REMEMBERED_CHARS = 64       # longer ones are not remembered
SPACE = "▁"
_STRETCH = re.compile(r" *[^ ]+| +$")
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


class Counter:
    """Counts the tokens of whole texts as the library does."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        same = self.model.normalize("a  b ﬁＡ ") in (f"{SPACE}a{SPACE}{SPACE}b ﬁＡ{SPACE}", "a  b ﬁＡ ")
        self.separable = same and not any(SPACE in p.lstrip(SPACE) for p in pieces) and self._count("") == 0
        self.known: dict[str, int] = {}

    def _count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def stretch(self, text: str) -> int:
        """Tokens of a stretch without its first space."""
        count = self.known.get(text)
        if count is None:
            count = self._count(text)
            if len(text) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return self._count(text)
        parts = text.split(" ")
        if all(parts):
            return sum(map(self.stretch, parts))
        total = 0
        for n, part in enumerate(_STRETCH.findall(text)):
            if n and not part.strip(" "):  # spaces at the end, behind a word
                total += self._count("a" + part) - self._count("a")
            else:
                total += self.stretch(part[1:] if n else part)
        return total


_counters: dict[str, Counter] = {}


def counter_of(model: bytes) -> Counter:
    """The counter of this worker process; it is kept, with what it remembers, from task to task."""
    key = tokenizer_digest(model)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(model)
    return _counters[key]


def tokenizer_digest(model: bytes) -> str:
    """Identity of a tokenizer: its file and the library's version."""
    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()


def normalised() -> F.Column:
    return F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")


def read_cache(docs: DataFrame, path: str) -> DataFrame:
    try:
        return docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return docs.sparkSession.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, model: bytes, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; new counts are appended to the table at `cache`.

    Without a cache path a new one in the shared folder is used. Rows of an append that was cut short do no harm: keys are read once.
    """
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    tokenizer = tokenizer_digest(model)
    content = F.unhex(F.sha2(normalised(), 256))
    text_key = F.xxhash64("text")
    keyed = write_stage(docs.select("doc_id", text_key.alias("text_key"), content.alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")), "keyed")
    known = read_cache(docs, cache).filter(F.col("tokenizer") == tokenizer).select("content", F.lit(True).alias("known")).distinct()
    contents = keyed.groupBy("content").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    contents = write_stage(contents.join(known, "content", "left"), "contents")
    # rows that are not encoded: their content is known, or another row stands for it
    spared = join_counted(keyed, contents, ["content"], "n").filter(F.col("known").isNotNull() | ~F.struct("doc_id", "text_key").eqNullSafe(F.col("first")))
    misses = match_rows(docs.select("doc_id", "text"), spared.select(row_key("text_key").alias("row")).distinct(), "left_anti")
    misses = misses.select(content.alias("content"), normalised().alias("text"))

    def step(batch: pa.RecordBatch) -> dict:
        count = counter_of(model).count
        return {"content": batch.column("content"), "n_tokens": pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())}

    new = map_batches(misses, step, "content binary, n_tokens bigint")
    new.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(docs, cache).filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted = write_stage(contents.select("content", "n").join(counts, "content"), "counted")
    return join_counted(keyed, counted, ["content"], "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
