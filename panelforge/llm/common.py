"""What several operators share: durable cuts in the lineage, text rules, tokenizers."""

from __future__ import annotations

import os
import re
import tempfile
from array import array
from pathlib import Path
from unicodedata import is_normalized

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
#: As a regular expression class for Java's and Python's engines.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut off from its lineage.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local session without one gets a temporary folder; on a cluster that is an
    error, as each executor would write to a disk of its own.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark) -> str:
    """The shared folder, set on the context if it wasn't."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows of a batch that goes to a Python worker: texts of a few kilobytes make a few megabytes.
BATCH_ROWS = 1_000


def for_workers(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for whole texts and whose Python workers find this package."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return df


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z, and nothing else, lower-cased.

    ``lower`` is far quicker than ``translate`` and gives the same string unless
    the text has upper-case letters outside ASCII, so only those texts pay.
    """
    other_upper = F.regexp_like(text, F.lit(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).when(other_upper, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


class WordTokenizer:
    """Token ids as little-endian uint32 bytes, with a bounded cache of what each chunk encodes to.

    Exact for tokenizers whose normalizer and pre-tokenizer never join text
    across a space, tab or newline, and that split runs of letters from
    punctuation: a text's ids are then the concatenation of its chunks' ids.
    ``tests/llm`` compares it with the plain encoder.
    """

    #: Chunks in the young half of the cache. When it is full it becomes the old half, from which chunks in use return.
    CACHE = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        # byte-level models spell bytes as printable characters: those that are printable stand for themselves
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self.spelling = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _mark(self, tail: str) -> bytes:
        if tail not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[tail] = self._pack(self.encoder.encode(tail, add_special_tokens=False).ids)
        return self.marks[tail]

    def _spelled(self, core: str) -> str | None:
        """A run of Latin letters as the model spells it; None for what needs the whole encoder."""
        if not core.isalpha():
            return None
        if core.isascii():
            return core.lower()
        if not _PAST_LATIN.search(core) and is_normalized("NFC", core):
            return "".join(map(self.spelling.__getitem__, core.lower().encode()))
        return None

    def _learn(self, chunks: list[str]) -> None:
        cache, old, tokenize, odd = self.cache, self.old, self.encoder.model.tokenize, []
        for chunk in chunks:
            ids = old.get(chunk)
            if ids is None:
                # letters and the marks after them are separate pre-tokens, so the marks' ids can be added afterwards
                core = chunk.rstrip(_MARKS)
                tail = self._mark(chunk[len(core) :]) if core else b""
                spelled = self._spelled(core)
                if spelled is None:
                    odd.append(chunk)
                    continue
                ids = (cache.get(core) or old.get(core)) if tail else None
                if ids is None:
                    ids = self._pack([t.id for t in tokenize(spelled)])
                    if tail:
                        cache[core] = ids
                ids += tail
            cache[chunk] = ids
        if odd:
            for chunk, found in zip(odd, self.encoder.encode_batch(odd, add_special_tokens=False), strict=True):
                cache[chunk] = self._pack(found.ids)

    def encode(self, text: str) -> bytes:
        # the tokenizer lower-cases; doing it here first halves the chunks to learn. Special tokens have a case
        if "<|" not in text and (text.isascii() or not _PAST_LATIN.search(text)):
            text = text.lower()
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            if len(self.cache) > self.CACHE:
                self.cache, self.old = {"": b""}, self.cache
            self._learn([c for c in set(chunks) if c not in self.cache])
            return b"".join(map(self.cache.__getitem__, chunks))


#: ASCII marks that never join the letters before them: all but the apostrophe.
_MARKS = ".,;:!?*#$%&|<>\"()[]{}-_/+=~^@`\\"
#: Letters whose lower case could differ between libraries, and combining marks, are beyond this range.
_PAST_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_folder(spark, name: str) -> str:
    """A new path below the shared checkpoint folder. Nothing is created."""
    from uuid import uuid4

    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


def remove_folder(spark, path: str) -> None:
    """Delete ``path`` through Hadoop's file systems, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
