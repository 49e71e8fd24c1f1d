"""Main text of HTML pages by minimum-cut labelling of their segments."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Segment, segments, text_of

#: Capacities are whole numbers of this part of a log odd.
UNIT = 100
#: Smoothness between neighbours under one element; each step that they stand apart in the tree takes STEP of it.
ADJACENT, STEP, SIBLINGS = 1.2, 0.6, 0.5
#: Log odds of the markup from which a segment teaches shapes, and the weight of the rule in segments.
SURE, PRIOR, LIMIT = 3.0, 50.0, 2.0


def minimum_cut(costs: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Labels of least energy: True costs a node -costs if that is positive, False costs it costs; an edge (i, j, w) costs w if its ends differ.

    The source joins nodes of positive cost, the sink the others. A node that outweighs all its edges has its
    label in some minimum cut, so it is settled first and its edges become capacities of its neighbours; what is left is cut by
    maximum flow along shortest augmenting paths. A node that is balanced is False."""
    cost, near = list(costs), defaultdict(dict)
    for i, j, w in edges:
        if i != j and w:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    pull = [sum(near[i].values()) if i in near else 0 for i in range(len(cost))]
    label: list[bool | None] = [None] * len(cost)
    queue = deque(range(len(cost)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) >= pull[i]:
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    pull[j] -= w
                    queue.append(j)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        source_side = _flow(rest, cost, near, label)
        for i in rest:
            label[i] = i in source_side
    return [bool(x) for x in label]


def _flow(rest: list[int], cost: list[int], near: Mapping[int, Mapping[int, int]], label: Sequence[bool | None]) -> set[int]:
    """The nodes of rest that the source still reaches when no more flow fits through (Dinic's levels and blocking flows)."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {source: {}, sink: {}}
    for i in rest:
        room[i] = {j: w for j, w in near[i].items() if label[j] is None}
    for i in rest:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0
        elif cost[i] < 0:
            room[i][sink], room[sink][i] = -cost[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, r in room[i].items():
                if r and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        ways = {i: iter(room[i].items()) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut_at = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0) + least
                    if not room[a][b]:
                        cut_at = min(cut_at, k + 1)
                del path[cut_at:]
                ways[path[-1]] = iter(list(room[path[-1]].items()))
                continue
            for j, _ in ways[i]:
                if room[i][j] and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1


def rule(shape: str) -> float:
    """Log odds of a shape before any page has been seen: long and punctuated is text, short and linked isn't."""
    kind, size, links, ends = shape.split("|")
    return (-0.6, -0.3, 0.3, 0.9, 1.4)[int(size)] + (0.3, -0.5, -1.8)[int(links)] + 0.4 * int(ends) + {"heading": 0.3, "p": 0.5, "item": -0.3}.get(kind, -0.2)


def learnt(counts: Mapping[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds by shape from how often it occurs in sure content and in sure boilerplate; few segments leave it near the rule."""
    total = {side: sum(n for (_, s), n in counts.items() if s == side) for side in (True, False)}
    out = {}
    for shape in {s for s, _ in counts}:
        good, bad = counts.get((shape, True), 0), counts.get((shape, False), 0)
        ratio = math.log((good + 0.5) / (total[True] + 1.0)) - math.log((bad + 0.5) / (total[False] + 1.0))
        out[shape] = max(-LIMIT, min(LIMIT, ((good + bad) * ratio + PRIOR * rule(shape)) / (good + bad + PRIOR)))
    return out


def label_page(html: str, model: Mapping[str, float]) -> tuple[list[Segment], list[bool]]:
    """The page's segments and which of them are the article's."""
    found = segments(html)
    costs, edges, last = [], [], {}
    for i, s in enumerate(found):
        shape = s.shape()
        costs.append(round(UNIT * (s.evidence + (model[shape] if shape in model else rule(shape)))))
        if i:
            edges.append((i - 1, i, round(UNIT * ADJACENT * STEP ** min(s.steps, 30))))
        if last.get(s.parent, i - 1) != i - 1:
            edges.append((last[s.parent], i, round(UNIT * SIBLINGS)))
        last[s.parent] = i
    return found, minimum_cut(costs, edges)


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, bool]] = Counter()
    for batch in batches:
        for html in batch.column(0):
            counts.update((s.shape(), s.evidence > 0) for s in segments(html.as_py() or "") if abs(s.evidence) >= SURE)
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["shape", "good", "n"])


def shape_model(pages: DataFrame) -> dict[str, float]:
    """Log odds of every shape of segment, learnt from all pages where markup is sure. There are 5 * 5 * 3 * 2 shapes at most, whatever the pages."""
    counts = pages.select("html").mapInArrow(_teach, "shape string, good boolean, n long").groupBy("shape", "good").agg(F.sum("n").alias("n"))
    return learnt({(r["shape"], r["good"]): r["n"] for r in counts.collect()})


def _extract(model: Mapping[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, kept = [], [], []
            for html in batch.column(1):
                found, labels = label_page(html.as_py() or "", model)
                chosen = [s for s, x in zip(found, labels, strict=True) if x]
                texts.append(text_of(chosen))
                n.append(len(found))
                kept.append(len(chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=["_page", "text", "n_segments", "n_kept"])

    return run


def extract_main_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), model: Mapping[str, float] | None = None) -> DataFrame:
    """The columns keep of each row of pages, with text, n_chars (its code points), n_segments and n_kept.

    A page is read in one pass into segments: runs of text of one block under one judgement. A segment's cost is the log odds
    that it is the article's: those of the elements, roles and names around it, and those of its shape (kind of
    block, words, links, how it ends), which are learnt from all pages' segments whose markup is sure (or given as model). Costs are the
    terminals' capacities; neighbours are joined by edges that weaken with their distance in the tree, and blocks
    under one parent by further ones; the minimum cut labels the segments. Kept are all segments on the article's
    side, in page order: white space inside a block (br among it) is one space, blocks are two line ends apart.

    Takes html; other columns than keep aren't read. Defined cases: a null or blank page has an empty text, n_chars 0; rows that
    repeat are extracted each; broken markup is read as far as it goes (a tag cut off at the end is dropped, a raw element or
    comment without end takes the rest); character references without a semicolon are decoded as browsers do;
    white space is what Unicode calls so, no-break spaces among it; no rows give no rows. A page is one task's
    work, linear in its length."""
    model = shape_model(pages) if model is None else model
    held = pages.select(F.struct(*keep).alias("_page"), "html")
    out = held.mapInArrow(_extract(dict(model)), f"_page {held.schema['_page'].dataType.simpleString()}, text string, n_segments long, n_kept long")
    return out.select("_page.*", "text", F.length("text").cast("long").alias("n_chars"), "n_segments", "n_kept")
