"""What several operators of this package share: tables in the shared folder, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from pathlib import Path

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.storage import shared_folder

#: What goes to Python at once: texts may be long, and each batch is held several times over.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}

_U = np.uint64


def tune(spark: SparkSession) -> None:
    """Settings that the Python passes of this package need, made before each of them where the session has none of its
    own. They stay, as plans read them when they run."""
    context = spark.sparkContext
    if context.master.startswith("local["):  # Python workers of this machine find the package wherever they start;
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # a cluster installs it
    given = spark.conf.getAll
    for key, most in ARROW.items():
        if key not in given:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of :func:`stored` made in each open :func:`scratch`.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside go at the end, but for the one that the caller passes to the function it gets."""
    _scratch.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    try:
        yield keep
    finally:
        made = _scratch.pop()
        stay = [p for p in made if any(f.endswith(p.rpartition("/")[2]) for f in kept)]
        if _scratch:
            _scratch[-1].extend(stay)
        for path in set(made).difference(stay):
            _delete(spark, path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (in whatever case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """None if every row of ``docs`` has a doc_id and no doc_id has two different texts. Else ``docs`` with doc_id replaced
    by a number of each (doc_id, text), in the order of doc_id, rows without one last, and the table (number, doc_id).
    Null texts are empty; texts are taken as equal by 128 bits of hash."""
    hashes = [F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))) for k in (0, 1)]
    texts = docs.select("doc_id", hashes[0].alias("a"), hashes[1].alias("b"))
    if texts.groupBy("doc_id").agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in "ab"]).where("doc_id is null or min_a < max_a or min_b < max_b").isEmpty():
        return None
    numbers = texts.distinct().orderBy(F.asc_nulls_last("doc_id"), "a", "b").withColumn("number", F.monotonically_increasing_id())
    own = {x: free_name(docs.columns, f"_{x}") for x in ("id", "a", "b", "number")}
    numbers = stored(numbers, "numbers")
    named = numbers.select("number", "doc_id")
    numbers = numbers.select(*[F.col(c).alias(own[x]) for x, c in (("id", "doc_id"), ("a", "a"), ("b", "b"), ("number", "number"))])
    out = docs.join(numbers, F.col("doc_id").eqNullSafe(F.col(own["id"])) & (hashes[0] == F.col(own["a"])) & (hashes[1] == F.col(own["b"])))
    return stored(out.withColumn("doc_id", F.col(own["number"])).select(*docs.columns), "numbered"), named


def _folders(df: DataFrame) -> set[str]:
    return {x.rpartition("/")[0] for x in df.inputFiles()}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once nothing reads it any more."""
    for folder in _folders(df):
        _delete(df.sparkSession, folder)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: Random odd multipliers and byte codes, from a fixed rule.
ODD = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
CODES = mixed(np.arange(1001, 1257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BASE, BASE_INV = _U(0xD6E8FEB86659FD93), _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits separates terms.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; the longest so far is kept."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            out = np.full(n, base, _U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


#: Words of more bytes than this are hashed by BLAKE2: polynomials of long words can be made to collide on purpose.
LONG_WORD = 256


def word_hashes(texts: list[bytes], breaks: np.ndarray = SPACES, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts in order, and each text's number of words.

    With ``heads``, each word's row also has hashes of its first so many bytes; a word that is no longer repeats itself.
    A word is a longest run of bytes outside ``breaks``. The hash is a polynomial over the word's bytes, taken from
    prefix sums, so the cost is a few passes over the bytes whatever the words are.
    """
    raw = LOWER[np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)]
    gap = breaks[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(CODES[raw] * up[: len(raw)], out=sums[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(start, ends), prepend=0) if texts else np.zeros(0, np.int64)
    words = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    for i in np.flatnonzero(end - start > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    if not heads:
        return words, count
    cut = [np.where(end - start > k, mixed((sums[np.minimum(start + k, end)] - sums[start]) * down[start] ^ ODD[k]), words) for k in heads]
    return np.stack([words, *cut], axis=1), count


def frugal(function):
    """A function for mapInArrow or mapInPandas that hands memory back at the end of its partition: workers are kept, and what one
    stage leaves in them would add up to what the next needs."""

    def partition(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return partition


def slabs(items: list, size, most: int = 1 << 18):
    """Runs of items of about ``most`` bytes, one item at least."""
    out, total = [], 0
    for x in items:
        if out and total + size(x) > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += size(x)
    if out:
        yield out


def utf8(column: pyarrow.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; nulls are empty."""
    return [b or b"" for b in column.cast(pyarrow.binary()).to_pylist()]


def record_batch(**columns) -> pyarrow.RecordBatch:
    """Arrow columns as they are, and others from arrays or lists; integers never pass through floats."""
    return pyarrow.RecordBatch.from_pydict({k: v if isinstance(v, (pyarrow.Array, pyarrow.ChunkedArray)) else pyarrow.array(v) for k, v in columns.items()})


def as_bytes(text) -> bytes:
    """UTF-8; null is empty."""
    return b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of the word shingles of one text, sorted; with fewer words than ``width``, of all its words."""
    n = len(words)
    if n == 0:
        return words[:0]
    k = min(n, width)
    h = np.zeros(n - k + 1, _U)
    for j in range(k):
        h += words[j : n - k + 1 + j] * ODD[j]
    h = mixed(h + _U(k))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
