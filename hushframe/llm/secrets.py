"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed patterns. A run of the hex or access class has its length in the pattern: runs are taken whole, so that asking
# for the length there keeps and drops the same matches as asking afterwards.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Runs of at least this many characters are tested.
SHORTEST = 20
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings, narrowest first; a run is read in the first that holds all its characters. Digits alone are numbers.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"), ("hex_upper", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("base36_upper", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_PLACES = [{c: i for i, c in enumerate(letters)} for _, letters in ENCODINGS]
#: Runs of like length are judged together; the lower ends of the classes.
STRATA = (20, 28, 40, 64, 128)
#: Steps of -log10 p to one decade, and the last step: p values are counted by step.
STEPS, LAST = 8, 240
#: A run that is random fails one of the three tests this seldom.
ALPHA = 0.001


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(run: str) -> tuple[int, int, float, bool] | None:
    """(encoding, length, chi-squared, random): whether the run passes for random in its encoding by all three tests:
    uniformity of the alphabet (chi-squared, and no class of it missing that chance would hardly leave out), runs above and
    below the alphabet's middle, and serial correlation."""
    body = run.rstrip("=")
    used = set(body)
    if used <= set(_DIGITS):
        return None
    code = next((i for i, p in enumerate(_PLACES) if used <= p.keys()), None)
    if code is None:
        return None
    place, m, n = _PLACES[code], len(_PLACES[code]), len(body)
    v = np.fromiter((place[c] for c in body), np.int64, n)
    count = np.bincount(v, minlength=m)
    chi = m / n * float((count * count).sum()) - n
    z_chi = (chi - (m - 1)) / math.sqrt(2 * (m - 1) * (1 - 1 / n))
    high = v >= m / 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        return code, n, chi, False
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n0 * n1 / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    d = v - v.mean()
    serial = float((d[1:] * d[:-1]).sum()) / float((d * d).sum())
    ok = 1 - _phi(z_chi) >= ALPHA
    letters = ENCODINGS[code][1]
    for kind in (_DIGITS, _LOWER, _UPPER):
        share = sum(c in kind for c in letters) / m
        ok &= not share or (1 - share) ** n >= 2 * ALPHA or not used.isdisjoint(kind)
    ok &= 2 * _phi(-abs(runs - mean) / spread) >= ALPHA
    ok &= 2 * _phi(-abs(serial + 1 / n) * math.sqrt(n)) >= ALPHA
    return code, n, chi, ok


def moments(frequency: dict[str, int]) -> list[tuple[float, float]]:
    """Of each encoding the sums of squares and cubes of its characters' shares in the corpus (each counted once more)."""
    out = []
    for _, letters in ENCODINGS:
        c = np.array([frequency.get(x, 0) + 1 for x in letters], float)
        p = c / c.sum()
        out.append((float((p**2).sum()), float((p**3).sum())))
    return out


def step_of(code: int, n: int, chi: float, ok: bool, of: list[tuple[float, float]]) -> int:
    """-log10 of the chance that characters drawn as the corpus has them are as even as this run, in steps; 0 for a run
    that doesn't pass for random. Mean and variance of the sum of squared counts are those of a multinomial."""
    if not ok:
        return 0
    m, (s2, s3) = len(ENCODINGS[code][1]), of[code]
    mean = m * (1 + (n - 1) * s2) - n
    var = (m / n) ** 2 * 2 * n * (n - 1) * max(1e-12, s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
    p = _phi((chi - mean) / math.sqrt(var))
    return min(LAST, int(-math.log10(max(p, 1e-300)) * STEPS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in the order of start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_JOINTS = re.compile("[/+]"), re.compile("[_-]"), re.compile("[/+_-]")


def pieces(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: what the fixed patterns leave of it, whole and in its pieces between ``/`` and
    ``+`` (paths), between ``_`` and ``-`` (names), and between all of them. Each has ``SHORTEST`` characters or more."""
    free, at = [], start
    for a, _, b in base:  # by start
        if a < end and start < b:
            free.append((at, min(a, end)))
            at = max(at, b)
    found = set()
    for a, b in [*free, (at, end)]:
        found.add((a, b))
        for joint in _JOINTS:
            cuts = [a - 1, *(m.start() for m in joint.finditer(text, a, b)), b]
            found.update((x + 1, y) for x, y in zip(cuts, cuts[1:]))
    return sorted((a, b) for a, b in found if len(text[a:b].rstrip("=")) >= SHORTEST)


def strongest(runs: list[dict], least: dict[int, int]) -> list[dict]:
    """The discoveries among tested spans: of those that overlap the one with most evidence, or else the longest."""
    passed = [r for r in runs if r["stratum"] in least and r["step"] >= least[r["stratum"]]]
    passed.sort(key=lambda r: (-r["step"], r["start"] - r["end"], r["start"]))
    out: list[dict] = []
    taken: list[tuple[int, int]] = []  # apart and sorted
    for r in passed:
        at = bisect_left(taken, (r["end"],))  # the spans before it start ahead of this one's end
        if not at or taken[at - 1][1] <= r["start"]:
            taken.insert(at, (r["start"], r["end"]))
            out.append(r)
    return sorted(out, key=lambda r: r["start"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and after each batch a row with its character counts."""
    for batch in batches:
        base, runs = [], []
        seen = np.zeros(128, np.int64)
        for value in batch.column(1):
            text = value.as_py()
            raw = np.frombuffer(text.encode(), np.uint8)
            seen += np.bincount(raw[raw < 128], minlength=128)
            found = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            own = []
            for m in RUN.finditer(text):
                for s, e in pieces(text, *m.span(), found):
                    if t := battery(text[s:e]):
                        own.append({"start": s, "end": e, "code": t[0], "n": t[1], "chi": t[2], "ok": t[3]})
            runs.append(own)
        ids = batch.column(0)
        ids = pa.concat_arrays([ids, pa.nulls(1, ids.type)])
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(base + [None], _BASE), pa.array(runs + [None], _RUNS), pa.array([None] * len(base) + [seen.tolist()], pa.list_(pa.int64()))],
            ["id", "base", "runs", "seen"],
        )


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_RUNS = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("n", pa.int32()), ("chi", pa.float64()), ("ok", pa.bool_())])
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def find_secrets(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): for each row the spans (start, kind, end; code points, end exclusive; kind is a place in
    ``KINDS``) of the fixed patterns, and those that the randomness tests add outside them.

    One pass over the whole texts finds the patterns, tests every run of 20 or more encoding characters outside them, whole
    and in its pieces (see ``pieces``), and counts the corpus's characters. Every tested piece counts as a test; of
    discoveries that overlap the strongest stays. A run's p value is the chance that characters drawn as the corpus has them are as even as it. The
    false-discovery rate is held at ``q`` in each class of length apart (Benjamini-Hochberg over all runs of the class,
    counted by steps of p): what is enough evidence for one length is not for another.

    A null or empty text has no spans. Ids pass through, null or repeated. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    runs = "array<struct<start:int,end:int,code:int,n:int,chi:double,ok:boolean>>"
    scan = written(rows.mapInArrow(_scan, f"id {kind}, base {_SPAN}, runs {runs}, seen array<bigint>"), "scan")
    counts = scan.filter("seen is not null").select(F.posexplode("seen").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n"))
    of = moments({chr(r["c"]): r["n"] for r in counts.collect()})  # 128 rows

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                out.append([
                    {"start": r["start"], "end": r["end"], "stratum": int(np.searchsorted(STRATA, r["n"], "right")),
                     "step": step_of(r["code"], r["n"], r["chi"], r["ok"], of)}
                    for r in own
                ])
            cell = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("step", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(cell))], ["id", "base", "runs"])

    tested = scan.filter("seen is null").select("id", "base", "runs").mapInArrow(
        steps, f"id {kind}, base {_SPAN}, runs array<struct<start:int,end:int,stratum:int,step:int>>"
    )
    tested = written(tested, "tested")
    each = tested.select(F.inline("runs")).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    least = thresholds([tuple(r) for r in each.collect()], q)  # classes x steps rows at most

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                [{"start": r["start"], "kind": KINDS.index("random"), "end": r["end"]} for r in strongest(own, least)]
                for own in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _BASE)], ["id", "base", "added"])

    added = tested.mapInArrow(chosen, f"id {kind}, base {_SPAN}, added {_SPAN}")
    return added.select(F.col("id").alias(id_col), "base", "added")


def thresholds(counts: list[tuple[int, int, int]], q: float) -> dict[int, int]:
    """(stratum, step, n) to the least step that is a discovery in each stratum, where there is one."""
    out = {}
    for stratum in {c[0] for c in counts}:
        own = sorted(((step, n) for s, step, n in counts if s == stratum), reverse=True)
        tests, upto = sum(n for _, n in own), 0
        for step, n in own:
            upto += n
            if step > 0 and 10 ** (-step / STEPS) <= upto * q / tests:
                out[stratum] = step
    return out


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
