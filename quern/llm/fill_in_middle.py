r"""Fill-in-the-middle transformation (operator 12) on code points.

Each text is decoded to a UTF-32 array of code points.  Where a character that
is no blank has a blank behind it a unit ends (`[\x20\x09-\x0D]*[^\x20\x09-\x0D]+`,
and blanks that end a text are one more), so comparing the classes of neighbours
and `flatnonzero` give all borders at once.  Two of the borders, of chosen rank,
cut the text into prefix, middle and suffix; the pieces are sliced from the
array, encoded again and put together with marks:

    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Ranks and form come from a hash of seed and doc_id alone, so the result depends
neither on partitions nor on other rows, and a lost task gives the same again.
A text that has a mark already stays plain, so `restore` is exact: a mark can't
arise where pieces meet, as each has one `<` and it comes first.

Nothing is shuffled; a slice of a batch holds :data:`SLICE` bytes of text, or
one longer text.

Defined results: a null text is empty and stays plain, output ``''``; a null id
hashes as an empty one.  Repeated rows are cut alike.  An empty table gives no
rows.  Extra columns are kept unless a result column has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import wordscan as ws

#: fixed marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
SLICE = 4_000_000
_RESULT = "units long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def borders(points: np.ndarray) -> np.ndarray:
    """0 and the places after each unit."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def cut(text: str, hashes: tuple[int, int, int, int], rate: int = 50, suffix_first: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """units, form, prefix_chars, middle_chars, output; `hashes` choose the two borders, whether to cut, and the form."""
    points = code_points(text)
    at = borders(points)
    n = len(at) - 1
    if not n or hashes[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted(int(at[h % (n + 1)]) for h in hashes[:2])
    prefix, middle, suffix = _text(points[:a]), _text(points[a:b]), _text(points[b:])
    p, s, m = MARKS
    if hashes[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _cuts(rate: int, suffix_first: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.stack([batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            texts = batch.column("text")
            for lo, hi, _, _ in ws.slices(texts, SLICE):
                rows = [cut(t, tuple(h), rate, suffix_first) for t, h in zip(texts.slice(lo, hi - lo).to_pylist(), hashes[lo:hi].tolist(), strict=True)]
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("all").slice(lo, hi - lo), *made], names=["all", *schema.names])

    return run


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """`docs` with units, form, prefix_chars, middle_chars (null if plain) and output.

    `rate` in 100 texts are cut, `suffix_first` in 100 of these have the form spm.
    """
    result = T._parse_datatype_string(_RESULT)
    keep = [c for c in docs.columns if c not in result.names]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substr(digest, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    df = docs.select(F.struct(*keep).alias("all"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *h)
    schema = T.StructType([df.schema["all"], *result.fields])
    arrow = pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in result])
    cuts = df.mapInArrow(_cuts(rate, suffix_first, arrow), schema)
    return cuts.select(*[F.col("all")[c].alias(c) for c in keep], *result.names)


def restore(output: Column, form: Column) -> Column:
    """The text that `output` was made of."""
    p, s, m = map(F.lit, MARKS)
    first = lambda x, mark: F.split_part(x, mark, F.lit(1))
    second = lambda x, mark: F.split_part(x, mark, F.lit(2))
    middle = second(output, m)
    psm = F.concat(second(first(output, s), p), middle, first(second(output, s), m))
    spm = F.concat(first(second(output, p), m), middle, second(first(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text that is restored from it."""
    made = transform(docs.select("doc_id", "text"), seed, rate, suffix_first)
    hashed = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", *hashed)
