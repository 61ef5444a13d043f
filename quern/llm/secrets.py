r"""Secret scans by corpus-wide ownership frequency (operator 4); DataFrame functions only.

Candidates are the strings of the base kinds (of an assignment its value) and
others that look like credentials: shapes of :data:`SHAPES` (key blocks, service
prefixes, signed tokens, credentials in addresses) and long runs of letters and
digits that change between kinds of character as often as chance has it, unless
they stand in an address or are an integrity digest.  All are hashed, and the
corpus tells in how many repositories and under how many owners each hash
occurs.  A string that :data:`EXAMPLE_OWNERS` owners or
:data:`EXAMPLE_REPOSITORIES` repositories have, whoever owns these, is a copied
example; any other is live-looking.

Spans of the base kinds are always reported.  Every live-looking candidate, of a
base kind or not, is reported as kind `live` too, at the place of its string; a
copied example is not.  So what the corpus says of a string is in the spans: a
password of one owner has a base and a live span, `changeme` a base span alone,
and a sample key of a vendor's manual that is of no base kind has none.  In the
query the repository is the document and the owner its source.

Places come without any Python: the pieces between matches (`split`) and the
matches (`regexp_extract_all`) of one pattern alternate, so running sums of
their lengths are the spans, in code points.  No pattern looks at a prefix only,
and loops over unbounded parts are possessive, so time grows with the text.

Counting owners of a hash groups twice, first by hash and owner, so a string
that a third of all rows have is reduced before it is shuffled.  Occurrences
are then held against the copied examples alone, on hash and one of
:data:`SALTS` salts, as other strings are rare by definition.

A key block is one span from its BEGIN line to its END line; where the latter
is missing, as far as runs of :data:`KEY_RUN` and more key characters follow.

Defined results: null text has no spans.  Repeated rows each get a row; copies
under one owner are one owner, rows of one id one repository.  A null source is
an owner of its own, a null id a repository of its own.  An empty table gives
no rows.  Extra columns are kept by `redact` and ignored by `scan`.  `redact`
masks all reported spans, copied examples of the base kinds among them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import saved

#: fixed patterns of the base kinds, in their order; failing lengths are dropped
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: for these two, a run that is long enough is the run that the open pattern finds
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_BEGIN, _END = (rf"-----{x} [A-Z0-9\x20]*?PRIVATE KEY(?:\x20BLOCK)?-----" for x in ("BEGIN", "END"))
KEY_RUN = 20
#: other shapes, which are candidates as they are
SHAPES = (
    _BEGIN + rf"(?:(?:[^-]|-(?!----))*+{_END}|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{{{KEY_RUN},}}+)*+)",
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{30,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|ASIA[A-Z0-9]{16,})",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*",
    r"://[^\s/@:]+:[^\s/@:]+@",
)
#: and runs, which are judged by their characters; none within 256 characters of an address's start, none behind a digest's name
_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
RUN = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{24})(?<!sha(?:256|384|512)-)(?<!://[^\s\"'<>]{0,256})" + _RUN
CANDIDATE = "|".join([*SHAPES, RUN])
#: least share of places in a run of random characters where the kind of character changes, and least digits: with letters of both cases, of one
CHANGES, DIGITS = (0.45, 0.25), (2, 3)
#: from this many owners, or repositories, on a candidate is a copied example
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 50
SALTS = 16
KINDS = ("assign", "access", "hex", "live")
_SPAN = "struct<start: bigint, rank: int, end: bigint, value: bigint, hash: string>"


def looks_secret(value: Column) -> Column:
    """Whether a match of CANDIDATE is a candidate."""
    changes = F.length(F.regexp_replace(value, "[a-z]+|[A-Z]+|[0-9]+|[+/]+", "x"))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    enough = lambda k: (digits >= DIGITS[k]) & (changes >= CHANGES[k] * F.length(value))
    random = value.rlike("[A-Za-z]") & F.when(value.rlike("[A-Z]") & value.rlike("[a-z]"), enough(0)).otherwise(enough(1))
    return F.when(value.rlike(f"^{_RUN}$"), random).otherwise(True)


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0, accept: Callable[[Column], Column] | None = None) -> Column:
    """Sorted spans of a pattern's matches in `text`, of those whose `group`, which ends the match, has `least` characters and is accepted; `value` is where it starts."""
    wanted = accept or (lambda value: F.length(value) >= least)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.zip_with(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), value, lambda x, v: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), v.alias("value")))
    zero = F.lit(0).cast("long")
    walked = F.aggregate(
        F.filter(steps, lambda x: x["hit"].isNotNull()),
        F.struct(zero.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(
                wanted(x["value"]),
                F.array_append(
                    acc["out"],
                    F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"]) - F.length(x["value"])).alias("value"), F.sha2(x["value"], 256).alias("hash")),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{_SPAN}>"))


def found(docs: DataFrame) -> DataFrame:
    """`docs` (columns row, owner, repository, text) with `base` spans and `candidates`: places of the strings of these, and of others that touch no access or hex span."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("base", F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    df = df.withColumn("other", _spans(text, CANDIDATE, 3, accept=looks_secret))
    apart = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["rank"] > 0) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    places = F.transform(F.concat("base", apart), lambda c: F.struct(c["value"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), c["value"].alias("value"), c["hash"].alias("hash")))
    return df.withColumn("candidates", F.array_sort(F.array_distinct(places))).drop("other")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, repositories, owners: how widely each hash in `spans` (owner, repository, hash) is spread."""
    by_owner = spans.groupBy("hash", "owner", "repository").agg(F.lit(1)).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def _judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, `base`, `spans` (base and live ones in order), and the numbers of live and of copied candidates."""
    df = saved(found(docs).select(*keep, "owner", "repository", "base", "candidates", F.monotonically_increasing_id().alias("row")), "secrets")
    some = df.where(F.size("candidates") > 0)
    each = some.select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c", F.col("c.hash").alias("hash"))
    spread = ownership(each).where((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    spread = spread.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("live"))
    judged = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["hash", "salt"], "left").fillna(True, "live")
    told = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live"), F.col("c"))).alias("told"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    some = some.join(told, "row").withColumn("spans", F.array_sort(F.concat("base", "told")))
    zero = F.lit(0).cast("long")
    none = df.where(F.size("candidates") == 0).withColumns({"spans": F.col("base"), "n_live": zero, "n_example": zero})
    wanted = [*keep, "base", "spans", "n_live", "n_example"]
    return none.select(*wanted).unionByName(some.select(*wanted))


def _written(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans; live and example say how far each candidate is spread."""
    df = docs.select("doc_id", "text", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    df = _judged(df, ["doc_id"])
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return df.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], "n_live", "n_example",
        F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """`docs` with every reported span of `text` replaced by `mark`; `n_chars`, if there, follows."""
    df = docs.select(F.struct("*").alias("all"), "text", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    df = _judged(df, ["all"])
    text = F.col("all.text")
    zero = F.lit(0).cast("long")
    new = F.aggregate(
        "spans",
        F.struct(zero.alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    df = df.withColumn("new", F.when(F.size("spans") > 0, new).otherwise(text))
    columns = [F.col("new").alias("text") if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("all")[c].alias(c) for c in docs.columns]
    return df.select(*columns)
