"""Small helpers shared by the operators."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most (one row at least).  Texts can be long, so
#: batches stay short.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20

#: White space between words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, or Spark's default where unset."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:
        return 200


def partitions_for(df: DataFrame, text: str, each: int = 64 << 20) -> int:
    """Partitions of about ``each`` bytes of the column's text, the session's number at least."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long") + 64)).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-size // each))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` over short batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def arrow_types(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def as_batch(columns: list, types: pa.Schema) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
              for c, f in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, schema=types)


class WordMemo:
    """A tokenizers file with a memory of the words it has encoded.

    Both public files cut at a space: no token of theirs holds anything before
    a space together with the space.  So a text is cut before its spaces, each
    different piece goes through the library once, and the pieces' ids are
    joined.  ``spaced`` keeps the space at the head of its piece (byte-level
    files); a space next to other white space then leaves the text whole, as
    white-space runs are tokens there.  A piece that ends in a full stop or comma
    after a character that the file's normalizer leaves a letter at the end is its
    letters' ids and the mark's own, as both files part letters from marks.  (U+0130
    becomes an i and a combining dot, which would go with the mark.)  Files that lower-case (``spaced`` false) get A-Z lower-cased
    before, but not next to combining marks, with which letters compose first.
    ``cap`` bounds the memory: beyond it the memory starts anew.
    """

    def __init__(self, path: str, spaced: bool, cap: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced, self.cap, self.memo = spaced, cap, {}
        #: New pieces are encoded many at a time with this token between them; pieces that hold a 0 go alone.
        [self.mark] = self.tok.encode(" 0", add_special_tokens=False).ids
        self.marks = {c: self._ids(f"a{c}")[len(self._ids("a")):] for c in ".,"}
        self.letters: dict[str, bool] = {"": False}
        self.mixed = re.compile(r"\s | \s").search

    def _ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ends_in_letter(self, c: str) -> bool:
        if c not in self.letters:
            self.letters[c] = (self.tok.normalizer.normalize_str(c) if self.tok.normalizer else c)[-1:].isalpha()
        return self.letters[c]

    def pieces(self, text: str) -> list[str]:
        if not self.spaced:
            raw = text.encode()
            if b"\xcc" not in raw and b"\xcd" not in raw:
                text = raw.lower().decode()
            return text.split(" ")
        if self.mixed(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        seen: set[str] = set()
        for p in cut:
            seen.update(p)
        if len(self.memo) > self.cap:
            self.memo.clear()
        memo = self.memo
        plain, odd, marked = [], [], []
        bare: set[str] = set()
        for w in seen.difference(memo):
            if w[-1:] in self.marks and self.ends_in_letter(w[-2:-1]):
                marked.append(w)
                if w[:-1] not in memo and w[:-1] not in seen:
                    bare.add(w[:-1])
            else:
                bare.add(w)
        for w in bare:
            (odd if "0" in w or w[-1:].isspace() or not w.strip() or (self.spaced and w[0] != " ") else plain).append(w)
        for w, e in zip(odd, self.tok.encode_batch_fast(odd, add_special_tokens=False)):
            memo[w] = array("I", e.ids).tobytes()
        many = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        for words, e in zip(many, self.tok.encode_batch_fast([" 0".join([*m, ""]) if self.spaced else " 0 ".join([*m, ""]) for m in many], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw, at = ids.tobytes(), 0
            for w, end in zip(words, ends, strict=True):
                memo[w] = raw[4 * at:4 * end]
                at = end + 1
        for w in marked:
            memo[w] = memo[w[:-1]] + self.marks[w[-1]]
        return [b"".join(map(memo.__getitem__, p)) for p in cut]


_MEMOS: dict[tuple[str, bool], WordMemo] = {}


def word_memo(path: str, spaced: bool) -> WordMemo:
    """One per worker process and file."""
    if (path, spaced) not in _MEMOS:
        _MEMOS[path, spaced] = WordMemo(path, spaced)
    return _MEMOS[path, spaced]
