"""URL filters (operator 6): rules first, then logistic regression on hashed character n-grams.

A rule names a host (with all subdomains) and the start of a path; the longest
that fits decides.  Every other URL is judged by a logistic regression on the
hashed 3- to 5-grams of host and path (:data:`DIMENSIONS` buckets, host and path
apart and each scaled to unit length), trained here on a small labelled table of
URLs.  The table that is used by default has hosts labelled by hand
(`url_table`, :data:`REPEATS` URLs each) and some hundreds of hosts made by rule
(:func:`labelled_urls`): of words of unwanted trades, alone, in pairs and beside
plain words, against hosts of plain words, of words that only look like the
others (:data:`ALIKE`) and of invented syllables.  Another table can be given.
A URL is blocked from a chance of :data:`BORDER` on: a host unlike any of the
table gets about even chances or less, and is not to be blocked for that.

Defined results: a null URL, or one without ``://``, has empty host and path;
no rule fits it and the method allows it.  Repeated rows each get a row.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import url_table
from quern.llm import wordscan as ws

DIMENSIONS = 1 << 16
BORDER, REPEATS = 0.65, 4
GRAMS = (3, 4, 5)
#: (verdict, host, path)
RULES: Sequence[tuple[str, str, str]] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: words of unwanted trades, plain words, and plain hosts that hold pieces of the former
UNWANTED = (
    "casino bet bets betting poker slots jackpot lottery roulette bingo gambling win wager odds pills viagra cialis meds pharmacy cheap replica payday loans adult porn xxx sex escort cam nude dating hookup"
    " ads adserver advert track tracker popunder click pixel spam scam phishing malware virus warez crack keygen torrent cracked clickbait doorway linkfarm farm free bonus prize rich forex"
).split()
PLAIN = (
    "news wiki docs journal school library science recipes travel garden history museum weather health sports music books forum code maps university city river mountain kitchen studio art film theatre language"
    " law court bank energy water forest animals birds farming family children photo design home house street market paper letter story green blue north south daily open world today center data tools project reading morning building spring learning evening sailing"
).split()
ALIKE = (
    "alphabet better-homes betterworld pillow-talk essex-council middlesex sussex camera-club campus cambridge adult-education adult-learning free-software free-library freedom farm-shop organic-farm farmers track-record"
    " race-track railtrack winter windows winchester click-chemistry oddity slot-machine-museum crackers cracked-pots virus-research virology prized-roses richmond medsci loads banana tracking-wildlife scampi spamalot-theatre"
).split()
BESIDE = "best online hot top club now hub my the go live 24 x zone express direct".split()
ENDS = "com org net info co.uk de io".split()
FRONTS = ("", "www.", "m.", "blog.", "shop.", "en.")
PATHS = ("/", "", "/en/{}", "/de/{}.html", "/{}/page/2", "/a/{}/index.html?id=7", "/fr/{}/#top", "/{}")


def labelled_urls(seed: int = 11) -> list[tuple[str, int]]:
    """(url, 1 unwanted / 0 wanted), two of a host."""
    rnd = random.Random(seed)
    invented = lambda: "".join(rnd.choice("bcdfghjklmnprstvwz") + rnd.choice(("a", "e", "i", "o", "u", "ei", "ou", "an", "er", "on", "in", "es")) for _ in range(rnd.randint(2, 4)))
    stems: dict[str, int] = {}
    for k, word in enumerate(UNWANTED):
        stems |= {word: 1, f"{word}-{UNWANTED[(7 * k + 3) % len(UNWANTED)]}": 1, f"{UNWANTED[(5 * k + 11) % len(UNWANTED)]}{word}": 1, f"{word}-{rnd.choice('xyz')}": 1, f"{word}-{invented()}": 1, f"{rnd.choice(PLAIN)}-{word}": 1}
        stems |= {f"{word}-{rnd.choice(BESIDE)}": 1, f"{rnd.choice(BESIDE)}{word}": 1, f"{word}{rnd.choice(BESIDE)}": 1}
    for k, word in enumerate(PLAIN):
        stems |= {word: 0, f"{word}-{PLAIN[(9 * k + 4) % len(PLAIN)]}": 0, f"{PLAIN[(4 * k + 9) % len(PLAIN)]}{word}": 0, f"{word}-{invented()}": 0, f"{invented()}-{word}": 0}
        stems |= {f"{word}-{rnd.choice(BESIDE)}": 0, f"{rnd.choice(BESIDE)}{word}": 0, f"{word}{rnd.choice(BESIDE)}": 0}
    stems |= dict.fromkeys(ALIKE, 0) | {invented(): 0 for _ in range(400)}
    out = []
    for stem, label in stems.items():
        for _ in range(2):
            middle = rnd.choice(("", "", "", ".example", ".site"))
            words = UNWANTED if label and rnd.random() < 0.3 else [*PLAIN, invented(), str(rnd.randrange(1000)), str(rnd.randrange(1000))]
            out.append((rnd.choice(("http://", "https://")) + rnd.choice(FRONTS) + stem + middle + "." + rnd.choice(ENDS) + rnd.choice(PATHS).format(rnd.choice(words)), label))
    return out


def known_urls() -> list[tuple[str, int]]:
    """(url, label), REPEATS of each host that is labelled by hand, with fronts and paths in turn."""
    out = []
    for hosts, label in ((url_table.WANTED, 0), (url_table.UNWANTED, 1)):
        for k, host in enumerate(hosts):
            for j in range(REPEATS):
                path = PATHS[(3 * k + j) % len(PATHS)].format(PLAIN[(7 * k + j) % len(PLAIN)])
                out.append((f"https://{FRONTS[(k + j) % len(FRONTS)]}{host}{path}", label))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _buckets(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of each string, with a border mark at its ends."""
    at, data = ws.text_buffers(column)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n + 2)
    marked = np.zeros(len(rows), np.uint64)
    inner = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(n)), n)
    marked[inner] = data.astype(np.uint64) + np.uint64(1)
    owner, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in GRAMS:
        if len(marked) < k:
            continue
        h = ws.grams(marked + np.uint64(1000 * salt + k), k)
        same = rows[: len(h)] == rows[k - 1 :]
        owner.append(rows[: len(h)][same])
        bucket.append((h[same] % np.uint64(DIMENSIONS)).astype(np.int64))
    both = np.unique(np.concatenate(owner) * DIMENSIONS + np.concatenate(bucket))
    return both // DIMENSIONS, both % DIMENSIONS


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) over host and path, each of unit length."""
    found = [_buckets(hosts, 1), _buckets(paths, 2)]
    value = [1 / np.sqrt(np.bincount(row, minlength=len(hosts)))[row] if len(row) else np.zeros(0) for row, _ in found]
    return np.concatenate([r for r, _ in found]), np.concatenate([b for _, b in found]), np.concatenate(value)


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def fit(rows: Sequence[tuple[str, int]], rounds: int = 600, rate: float = 30.0, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic regression, by full gradient steps."""
    pieces = [_split(u) for u, _ in rows]
    row, bucket, value = features(pa.array([h for h, _ in pieces], pa.string()), pa.array([p for _, p in pieces], pa.string()))
    y = np.array([float(label) for _, label in rows])
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(y)) + b))) - y
        w -= rate * (np.bincount(bucket, error[row] * value, DIMENSIONS) / len(y) + decay * w)
        b -= error.mean()
    return w, b


def score(hosts: pa.Array, paths: pa.Array, w: np.ndarray, b: float) -> np.ndarray:
    """Chance of being unwanted."""
    row, bucket, value = features(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(hosts)) + b)))


@cache
def default_model() -> tuple[np.ndarray, float]:
    return fit(labelled_urls() + known_urls())


_SCHEMA = "page_id long, host string, path string, rule string, verdict string, p_unwanted double"


def _judged(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                empty = np.array([not h and not p for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)])
                p = np.where(empty, 0.0, score(part.column("host"), part.column("path"), w, b))
                verdict = [v if v is not None else "block" if x >= BORDER else "allow" for v, x in zip(part.column("verdict").to_pylist(), p.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "host", "path", "rule")], pa.array(verdict, pa.string()), pa.array(p)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_unwanted for every row of `pages` (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    model = default_model() if labelled is None else fit(labelled)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    return df.mapInArrow(_judged(pages.sparkSession.sparkContext.broadcast(model)), _SCHEMA)
