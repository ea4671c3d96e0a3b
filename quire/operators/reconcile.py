"""Several readings of a page made one: alignment, greedy de-duplication, settlement."""

from __future__ import annotations

import math
import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import accumulate
from operator import sub

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pack import Pack

#: What a pair's similarity must exceed to earn, what a gap costs, blocks that one may match, and
#: characters of a text that count for its similarity: those of a page's readings, or all.
FLOOR, GAP, MERGED = 0.4, -0.05, 8
COMPARED, WHOLE = 2000, sys.maxsize
#: Similarity over which a block repeats another, from which readings are the same, and under which they
#: are no readings of one text.
REPEATS, SAME, UNLIKE = 0.9, 0.999, 0.45
#: Readers in the order in which one leads; the first is the page's own text and settles what it says. Others by name.
LEADING, AUTHORITY = ("pdfTextLayer", "visionOCR"), "pdfTextLayer"


def _distance(a: str, b: str) -> int:
    """Edit distance by bit vectors: a column of the table is two integers, one step a character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    full, top, at = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, d = full, 0, m
    for c in b:
        eq = at.get(c, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(level | up) & full, up & level
        d += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~((eq | down) | plus) & full, plus & (eq | down)
    return d


def text_similarity(a: str, b: str) -> float:
    a, b = a[:COMPARED], b[:COMPARED]
    if not a or not b:
        return float(a == b)
    return 1.0 if a == b else 1 - _distance(a, b) / max(len(a), len(b))


def _left_out(long: str, short: str) -> bool:
    """Whether ``short`` is ``long`` with characters left out: their distance is then that of their lengths."""
    rest = iter(long)
    return all(c in rest for c in short)


class _Beginnings:
    """Edit distances of one text to the beginnings of another that grows: :func:`_distance`, whose column tells the
    distance to all that was read so far, so that a text and one to eight others take one pass."""

    def __init__(self, text: str, at: dict[str, int], parts: list[str], compared: int = COMPARED):
        self.at, self.full, self.up, self.down = at, (1 << len(text)) - 1, (1 << len(text)) - 1, 0
        self.joined, self.ends, self.known = "".join(parts)[:compared], [min(compared, n) for n in accumulate(map(len, parts))], []

    def distance(self, n: int) -> int:
        """To the first ``n`` parts, joined."""
        at, full, up, down = self.at, self.full, self.up, self.down
        while len(self.known) < n:
            begin, end = self.ends[len(self.known) - 1] if self.known else 0, self.ends[len(self.known)]
            for c in self.joined[begin:end]:
                eq = at.get(c, 0)
                level = ((((eq & up) + up) ^ up) | eq | down) & full
                plus, minus = (down | full ^ (level | up)) << 1 & full | 1, (up & level) << 1 & full
                up, down = minus | full ^ (level | plus), plus & level
            self.known.append(end + up.bit_count() - down.bit_count())
        self.up, self.down = up, down
        return self.known[n - 1]


def _places(text: str) -> dict[str, int]:
    """For each character of a text where it stands, as bits."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        at[c].append(i)
    out = {}
    for c, places in at.items():
        bits = bytearray(len(text) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


#: Characters of a shingle, and cells on either side of the anchors that the first, quick alignment works out.
SHINGLE, NEAR = 5, 12


def _shingles(t: str) -> Counter:
    return Counter(zip(*(t[k:] for k in range(SHINGLE)), strict=False))


def _most(own: list[str], mine: list[Counter], other: list[Counter], compared: int = COMPARED) -> list[float]:
    """For each text of ``own`` (shingles: ``mine``) at least what its share of any pair with texts of the other side earns.

    An edit changes at most SHINGLE shingles, so a text that shares few with the texts around a place is far from any
    of them. Of a pair with several of ``own``, none has more than half of the 0.6 that a pair may earn.
    """
    held: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for j, grams in enumerate(other):
        for g, n in grams.items():
            held[g].append((j, n))
    out = []
    for t, grams in zip(own, mine, strict=True):
        n = min(len(t), compared)
        if n < 2 * SHINGLE:
            out.append(1 - FLOOR)
            continue
        shared = [0] * len(other)
        for g, k in grams.items():
            for j, m in held.get(g, ()):
                shared[j] += m if m < k else k
        sums = [*accumulate(shared, initial=0)]
        window = max(map(sub, sums[MERGED:], sums)) if len(sums) > MERGED else sums[-1]
        alike = min(n, window + (SHINGLE - 1) * MERGED)  # and those over the ends of two texts
        out.append(max((1 - FLOOR) / 2, 1 - (n - SHINGLE + 1 - alike) / (SHINGLE * n) - FLOOR))
    return out


def _once(texts: list[str], compared: int) -> dict[str, int]:
    """Where the shingles stand that only one of the texts holds."""
    at: dict[str, int] = {}
    for i, t in enumerate(texts):
        for g in _shingles(t[:compared]):
            at[g] = -1 if g in at else i
    return {g: i for g, i in at.items() if i >= 0}


def _band(left: list[str], right: list[str], compared: int = COMPARED) -> list[tuple[int, int]]:
    """For each row the columns near the anchors: texts that share shingles found once on each side, in the longest
    chain that rises on both, and the straight way between them."""
    votes: dict[int, Counter] = defaultdict(Counter)
    other = _once(right, compared)
    for g, i in _once(left, compared).items():
        if g in other:
            votes[i][other[g]] += 1
    tails, ends, before = [], [], {}
    for i in sorted(votes):
        j = max(votes[i], key=lambda k: (votes[i][k], -k))
        at = bisect_right(tails, j)
        before[i] = (j, ends[at - 1] if at else None)
        tails[at:], ends[at:] = [j, *tails[at + 1 :]], [i, *ends[at + 1 :]]
    chain, i = [], ends[-1] if ends else None
    while i is not None:
        chain.append((i + 1, before[i][0] + 1))
        i = before[i][1]
    out, last = [(0, NEAR)], (0, 0)
    for end in [*reversed(chain), (len(left), len(right))]:
        for i in range(last[0] + 1, end[0] + 1):
            begin, stop = (last[1] + (end[1] - last[1]) * (k - last[0]) // (end[0] - last[0]) for k in (i - 1, i))
            out.append((begin - NEAR, stop + NEAR))
        last = end
    out[-1] = (out[-1][0], len(right))
    return out


class _Aligner:
    """The table of two lists' alignment, of which only the cells are worked out that the best way may pass."""

    def __init__(self, left: list[str], right: list[str], compared: int = COMPARED):
        self.left, self.right, self.compared, self.known = left, right, compared, {}
        self.places: list[dict[int, dict[str, int]]] = [{}, {}]
        self.begun: dict[tuple[int, int, int], _Beginnings] = {}
        grams = [[_shingles(t[:compared]) for t in side] for side in (left, right)]
        self.rest = [[*accumulate(reversed(_most(*x, compared)), initial=0.0)][::-1] for x in ((left, *grams), (right, *grams[::-1]))]
        self.sizes = [[len(t) for t in side] for side in (left, right)]

    def similar(self, i: int, a: int, j: int, b: int) -> float:
        at = (i, a, j, b)
        if at not in self.known:
            x, y = "".join(self.left[i - a : i])[: self.compared], "".join(self.right[j - b : j])[: self.compared]
            if not x or not y or x == y:
                self.known[at] = float(x == y)
            else:
                short, long = sorted((x, y), key=len)
                self.known[at] = 1 - (len(long) - len(short) if _left_out(long, short) else self.distance(i, a, j, b)) / len(long)
        return self.known[at]

    def distance(self, i: int, a: int, j: int, b: int) -> int:
        """Of a text of one side to some of the other's, by the pass that begins with the first of these."""
        side = int(a > 1)  # where the one text stands
        one, first, n = (i - 1, j - b, b) if not side else (j - 1, i - a, a)
        if (side, one, first) not in self.begun:
            text, others = (self.left, self.right) if not side else (self.right, self.left)
            text = text[one][: self.compared]
            if one not in self.places[side]:
                self.places[side][one] = _places(text)
            self.begun[side, one, first] = _Beginnings(text, self.places[side][one], others[first : first + MERGED], self.compared)
        return self.begun[side, one, first].distance(n)

    def ahead(self, i: int, j: int) -> float:
        """At least what any way earns from a cell to the end."""
        return min(self.rest[0][i], self.rest[1][j])

    def run(self, least: float, band: list[tuple[int, int]] | None) -> tuple[float, dict[tuple[int, int], tuple[int, int]]]:
        """The best way's earnings among those that may come to ``least``, and how each cell is reached.

        With a ``band`` only the cells in it are followed: a way, but maybe not the best.
        """
        rows, cols = len(self.left), len(self.right)
        best: list[dict[int, float]] = []
        came: dict[tuple[int, int], tuple[int, int]] = {}
        for i in range(rows + 1):
            row: dict[int, float] = {}
            best.append(row)
            # passes that no later row goes on with: those along the right, and those begun too far above
            self.begun = {k: v for k, v in self.begun.items() if k[0] and k[2] >= i - MERGED}
            # columns that a move from a cell before may reach; skips to the right extend them as they go
            reach = {0} if not i else set(best[i - 1]) | {j + b for j in best[i - 1] for b in range(1, MERGED + 1)} | {j + 1 for k in range(2, min(MERGED, i) + 1) for j in best[i - k]}
            todo = sorted(j for j in reach if j <= cols)
            at, (low, high) = 0, band[i] if band else (0, cols)
            while at < len(todo):
                j = todo[at]
                at += 1
                top, move = (0.0, (0, 0)) if not i and not j else (-math.inf, (0, 0))
                for a, b in ((1, 0), (0, 1)):
                    if a <= i and b <= j and best[i - a].get(j - b, -math.inf) + GAP > top:
                        top, move = best[i - a][j - b] + GAP, (a, b)
                if i and j:
                    for a, b in [(1, k) for k in range(1, min(MERGED, j) + 1)] + [(k, 1) for k in range(2, min(MERGED, i) + 1)]:
                        base = best[i - a].get(j - b)
                        if base is None:
                            continue
                        x, y = (min(self.compared, sum(s[e - k : e])) for s, e, k in ((self.sizes[0], i, a), (self.sizes[1], j, b)))
                        bound = min(x, y) / max(x, y, 1) if x or y else 1.0
                        if base + bound - FLOOR > top and base + (value := self.similar(i, a, j, b) - FLOOR) > top:
                            top, move = base + value, (a, b)
                if low <= j <= high and top + self.ahead(i, j) >= least - 1e-9:
                    row[j] = top
                    came[i, j] = move
                    if j < cols and (at == len(todo) or todo[at] != j + 1):
                        todo.insert(at, j + 1)
        return best[rows].get(cols, -math.inf), came


def align_texts(left: list[str], right: list[str], compared: int = COMPARED) -> list[tuple[range, range, float]]:
    """Ordered full outer join of two lists: (left members, right members, similarity), one to up to eight either way.

    A pair's texts count by their first ``compared`` characters, or :data:`WHOLE`.

    Dynamic programming; a pair earns its similarity over 0.4, a gap costs 0.05; moves are tried in a fixed order and
    only a strictly better one replaces the last. A move whose lengths alone keep it from being better is not scored.

    The result is that of the full table. A quick alignment around anchors first earns what the best one earns at least; then only
    cells are worked out from which that can still be reached by what the texts' shared shingles allow. For readings of
    one text these are few around the diagonal, so the work grows with the length and not with its square; readings
    that have little in common take the full table.
    """
    table = _Aligner(left, right, compared)
    least, _ = table.run(-math.inf, _band(left, right, compared))
    if least == -math.inf:
        least = GAP * (len(left) + len(right))  # nothing paired
    _, came = table.run(least, None)
    out, i, j = [], len(left), len(right)
    while i or j:
        a, b = came[i, j]
        out.append((range(i - a, i), range(j - b, j), table.similar(i, a, j, b) if a and b else 0.0))
        i, j = i - a, j - b
    return out[::-1]


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pair, left_text, right_text, n_left, n_right, similarity (of whole texts) of two block tables (keys, ord, text).

    A group's texts are aligned in one task; for readings of one text that takes work in proportion to their number.
    Rows of one place follow each other by text; null texts are empty; a group without one side has gaps alone.
    """
    schema = left.select(*keys).withColumns({"pair": F.lit(0), "left_text": F.lit(""), "right_text": F.lit(""), "n_left": F.lit(0), "n_right": F.lit(0), "similarity": F.lit(0.0)}).schema

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (d.fillna({"text": ""}).sort_values(["ord", "text"], kind="stable")["text"].tolist() for d in (a, b))
        rows = [(*key, n, "".join(x[i] for i in p), "".join(y[i] for i in q), len(p), len(q), s) for n, (p, q, s) in enumerate(align_texts(x, y, WHOLE))]
        return pd.DataFrame(rows, columns=[*keys, "pair", "left_text", "right_text", "n_left", "n_right", "similarity"])

    # a group's texts are few and their work is long: by a number of tasks, which small sizes would bring together
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, other = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right))
    return one.cogroup(other).applyInPandas(run, schema)


def without_repeats(texts: Column) -> Column:
    """An ordered array of texts without those over 0.9 similar to one kept before."""
    return F.aggregate(texts, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: T.similarity(k, t, COMPARED) > REPEATS), kept).otherwise(F.concat(kept, F.array(t))))


def differ_in_figures(a: Column, b: Column) -> Column:
    """Whether two texts are the same but for their figures."""
    bare = lambda c: F.regexp_replace(c, "[0-9０-９]", "")
    return (bare(a) == bare(b)) & ~T.number_runs(a).eqNullSafe(T.number_runs(b))


def settle(left: Column, right: Column, similarity: Column, authoritative: Column, translatable: Column, answer: Column, pack: Pack) -> Column:
    """struct(text, agreement, kind) of one aligned pair. ``answer`` is an adjudicator's, null without one.

    A missing side leaves the other (a blank one is dropped: text null); an authoritative reading wins; equal texts
    are unanimous; what is not worth asking about, or differs in figures only, goes to the left by default.
    """
    a, b = T.normalized(F.coalesce(left, F.lit("")), pack), T.normalized(F.coalesce(right, F.lit("")), pack)
    out = lambda text, agreement, kind: F.struct(text.cast("string").alias("text"), agreement.cast("double").alias("agreement"), F.lit(kind).alias("kind"))
    none = F.lit(None)
    return (
        F.when(a == "", out(F.nullif(b, F.lit("")), F.lit(0.0), "single"))
        .when(b == "", out(a, none, "single"))
        .when(authoritative, out(a, similarity, "textLayer"))
        .when((similarity >= SAME) | (a == b), out(a, F.lit(1.0), "unanimous"))
        .when(~translatable | (similarity < UNLIKE) | answer.isNull() | differ_in_figures(a, b), out(a, similarity, "defaulted"))
        .when(F.upper(F.trim(answer)).startswith("B"), out(b, similarity, "adjudicated"))
        .otherwise(out(a, similarity, "adjudicated"))
    )


# --- a page's readings made one --------------------------------------------------------------------------------------

#: An adjudicator's answer to (text before, reading A, reading B); one that begins with B takes B. It may raise.
Adjudicator = Callable[[str | None, str, str], str]
BECAUSE_NONE, BECAUSE_UNLIKE, BECAUSE_FIGURES = "no model could choose", "the readings are too unlike to be of one text", "they differ in figures alone, and a recognizer makes none up"
_RECONCILED = "ord int, kind string, text string, n_lines int, x double, y double, w double, h double, candidates array<struct<reader:string,text:string>>, agreement double, settlement string, reader string, because string, context_before string"


def normalize(text: str, pack: Pack) -> str:
    """:func:`quire.functions.text.normalized` of one string."""
    if pack.spaced:
        return " ".join(text.split())
    return re.sub(r"[ \u3000]+", lambda m: _between(text, m, f"[{pack.script}]"), text).strip()


def _between(text: str, m: re.Match, script: str) -> str:
    """What a run of blanks becomes: nothing between two characters of the script, else one blank."""
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    return "" if re.match(script, before) and re.match(script, after) else " "


def figures(text: str) -> list[str]:
    """:func:`quire.functions.text.number_runs` of one string."""
    folded = text.translate({0xFF10 + i: str(i) for i in range(10)} | {0xFF0E: ".", 0xFF0C: ","})
    return [r.replace(",", "").rstrip(".") for r in re.findall("[0-9][0-9.,]*", folded)]


def difference(a: str, b: str) -> str:
    """:func:`quire.functions.text.quoted_difference` of two strings."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    if not left or not right or not left.strip() and not right.strip():
        return "they differed"
    quote = lambda x: f"“{x[:24]}”" if x else "nothing"
    return f"{quote(left.strip())} against {quote(right.strip())}"


def _settled(left: list[dict], right: list[dict], similarity: float, primary: str, secondary: str, before: str | None, pack: Pack, adjudicator: Adjudicator | None) -> dict | None:
    a, b = (normalize("".join(x["text"] for x in side), pack) for side in (left, right))
    said = dict(context_before=before, because=None)
    if not left:
        if not b:
            return None
        own = right[0]
        return said | dict(kind=own["kind"], text=b, n_lines=sum(x["n_lines"] for x in right), box=[own[k] for k in "xywh"], candidates=[(secondary, b)], agreement=0.0, settlement="single", reader=secondary)
    x0, y0 = min(x["x"] for x in left), min(x["y"] for x in left)
    box = [x0, y0, max(x["x"] + x["w"] for x in left) - x0, max(x["y"] + x["h"] for x in left) - y0]
    said |= dict(kind=left[0]["kind"], text=a, n_lines=sum(x["n_lines"] for x in left), box=box)
    if not right:
        return said | dict(candidates=[(primary, a)], agreement=None, settlement="single", reader=primary)
    said |= dict(candidates=[(primary, a), (secondary, b)], agreement=similarity, reader=primary)
    if primary == AUTHORITY:
        return said | dict(settlement="textLayer")
    if similarity >= SAME or a == b:
        return said | dict(agreement=1.0, settlement="unanimous")
    if left[0]["kind"] == "pageFurniture" or similarity < UNLIKE or adjudicator is None:
        return said | dict(settlement="defaulted", because=BECAUSE_NONE if adjudicator is None else BECAUSE_UNLIKE)
    if re.sub("[0-9０-９]", "", a) == re.sub("[0-9０-９]", "", b) and figures(a) != figures(b):
        return said | dict(settlement="defaulted", because=BECAUSE_FIGURES)
    try:
        chose = adjudicator(before, a, b).upper().startswith("B")
    except Exception as e:  # noqa: BLE001  the block says so
        return said | dict(settlement="defaulted", because=str(e))
    return said | dict(text=b if chose else a, settlement="adjudicated", reader=secondary if chose else primary, because=difference(a, b))


def reconcile_page(readings: dict[str, list[dict]], pack: Pack, adjudicator: Adjudicator | None = None) -> list[dict]:
    """The blocks of one page from its readers' blocks (text, kind, n_lines, x, y, w, h), each list in order."""
    readers = sorted((r for r, blocks in readings.items() if blocks), key=lambda r: (r != AUTHORITY, r))
    if not readers:
        return []
    primary = next((r for r in LEADING if r in readers), readers[0])
    secondary = next((r for r in readers if r != primary), None)
    left = readings[primary]
    if secondary is None:
        settlement = "textLayer" if primary == AUTHORITY else "single"
        return [dict(kind=x["kind"], text=x["text"], n_lines=x["n_lines"], box=[x[k] for k in "xywh"], candidates=[(primary, x["text"])], agreement=None, settlement=settlement, reader=primary, because=None, context_before=None) for x in left]
    right: list[dict] = []
    for x in readings[secondary]:
        if not any(text_similarity(k["text"], x["text"]) > REPEATS for k in right):
            right.append(x)
    out: list[dict] = []
    for p, q, s in align_texts([x["text"] for x in left], [x["text"] for x in right]):
        block = _settled([left[i] for i in p], [right[i] for i in q], s, primary, secondary, out[-1]["text"] if out else None, pack, adjudicator)
        if block:
            out.append(block)
    return out


def reconciled(readings: DataFrame, pack: Pack, adjudicator: Adjudicator | None = None) -> DataFrame:
    """doc_id, page and a page's settled blocks, of readings (doc_id, page, reader, ord, kind, text, n_lines, x, y, w, h).

    One reader's blocks pass as they are. Of two, the leading one's are aligned with the other's, repeats of which are
    left out, and each pair is settled in order; the adjudicator sees what was settled before. A third reader is not
    asked. Pages are groups and short by nature (tens of blocks). Null texts are empty.
    """
    types = dict(readings.dtypes)
    names = ["text", "kind", "n_lines", "x", "y", "w", "h"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        by: dict[str, list[dict]] = {}
        for r in sorted(t.to_pylist(), key=lambda r: (r["reader"], r["ord"])):
            by.setdefault(r["reader"], []).append({k: r[k] for k in names} | {"text": r["text"] or ""})
        blocks = reconcile_page(by, pack, adjudicator)
        rows = {"doc_id": [key[0].as_py()] * len(blocks), "page": [key[1].as_py()] * len(blocks), "ord": list(range(len(blocks)))}
        rows |= {k: [b[k] for b in blocks] for k in ("kind", "text", "n_lines")} | {k: [b["box"][i] for b in blocks] for i, k in enumerate("xywh")}
        rows["candidates"] = [[{"reader": r, "text": x} for r, x in b["candidates"]] for b in blocks]
        rows |= {k: [b[k] for b in blocks] for k in ("agreement", "settlement", "reader", "because", "context_before")}
        kinds = [t.schema.field("doc_id").type, t.schema.field("page").type, pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.struct([("reader", pa.string()), ("text", pa.string())])), pa.float64(), *[pa.string()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    rows = readings.select("doc_id", "page", "reader", "ord", "kind", "text", F.col("n_lines").cast("int").alias("n_lines"), *[F.col(k).cast("double").alias(k) for k in "xywh"])
    return rows.groupBy("doc_id", "page").applyInArrow(run, f"doc_id {types['doc_id']}, page {types['page']}, {_RECONCILED}")
