"""The dating stage against the same rules in plain Python, node by node."""

import datetime as dt
import random

from palimpsest.operators import dating, snapshot

DAY = dt.date(1900, 1, 1)


def span(dates, source="AGGREGATED"):
    dates = [d for d in dates if d]
    lo, hi = min((d[0] for d in dates if d[0]), default=None), max((d[1] for d in dates if d[1]), default=None)
    if not dates or (lo and hi and lo > hi):
        return None
    return (lo, hi, min(d[2] for d in dates), source)


def down(d, lo_hi=None):
    return (*(lo_hi or d[:2]), round(d[2] * 0.9, 2), "INHERITED")


def between(pages, prior):
    seen = [(n, d) for n, d in sorted(pages.items()) if d]
    if any(a[1][0] > b[1][0] or a[1][1] > b[1][1] for a, b in zip(seen, seen[1:], strict=False)):
        return {}
    out = {}
    for n in (n for n, d in pages.items() if not d):
        p, q = max((x for x in seen if x[0] < n), default=None), min((x for x in seen if x[0] > n), default=None)
        if p and q:
            lo, hi = p[1][1], q[1][0]
            lo, hi = (p[1][0], q[1][1]) if lo > hi else (lo, hi)
            conf = max(20, 80 - 10 * min(n - p[0], q[0] - n)) / 100
        elif p or q:
            lo, hi = (p[1][1], None) if p else (None, q[1][0])
            conf = max(10, 60 - 10 * abs(n - (p or q)[0])) / 100
            if prior:
                a, b = max((x for x in (lo, prior[0]) if x), default=None), min((x for x in (hi, prior[1]) if x), default=None)
                lo, hi = (a, b) if not (a and b and a > b) else (lo, hi)
        else:
            continue
        out[n] = (lo, hi, conf, "INTERPOLATED")
    return out


def plain(nodes, on, numbers, prior, guesses):
    """nodes: {path: (nid, day or None)} in order; on: {path: pages} of leaves."""
    kids = {p: [q for q in nodes if q.rpartition(".")[0] == p] for p in nodes}
    date = {p: (d, d, 0.95, "EXPLICIT") if d else guesses.get(p) for p, (_, d) in nodes.items()}
    pages = {n: span([date[p] for p in nodes if date[p] and date[p][3] == "EXPLICIT" and n in on.get(p, ())]) for n in numbers}
    pages |= between(pages, prior)
    for p in reversed(nodes):
        below = [date[k] for k in kids[p] if date[k]]
        date[p] = span(below) if below else date[p]
    whole = span([date[p] for p in nodes if "." not in p] + list(pages.values())) or prior
    fill = whole if whole and whole[3] in ("INFERRED", "METADATA") else None
    pages = {n: d or (down(fill) if fill else None) for n, d in pages.items()}
    for p in nodes:
        if date[p]:
            continue
        up = p.rpartition(".")[0]
        near = date.get(up)
        drawn = span([pages[n] for q in nodes if q == p or q.startswith(p + ".") for n in on.get(q, ())])
        if drawn and near:
            lo, hi = max((x for x in (drawn[0], near[0]) if x), default=None), min((x for x in (drawn[1], near[1]) if x), default=None)
            date[p] = down(drawn, near[:2] if lo and hi and lo > hi else (lo, hi))
        elif drawn or near or fill:
            date[p] = down(drawn or near or fill)
    return date, pages, whole


def test_stage(spark):
    rng = random.Random(8)
    rows, spots, numbers, priors, guesses, want, openings = [], [], [], [], [], {}, []
    for c in range(40):
        paths = []
        for a in range(1, rng.randrange(2, 5)):
            paths.append(f"{a:04d}")
            for b in range(1, rng.randrange(1, 4)):
                paths.append(f"{a:04d}.{b:04d}")
                paths += [f"{a:04d}.{b:04d}.{k:04d}" for k in range(1, rng.randrange(1, 4))]
        inner = {p.rpartition(".")[0] for p in paths}
        rate = rng.choice([0.0, 0.2, 0.5])
        nodes = {p: (i, DAY + dt.timedelta(rng.randrange(200) if c % 2 else i * 9) if p not in inner and rng.random() < rate else None) for i, p in enumerate(paths, 1)}
        on = {p: [1 + i * 6 // len(paths)] for i, p in enumerate(paths) if p not in inner and rng.random() < 0.8}
        prior = rng.choice([None, (dt.date(1900, 1, 1), dt.date(1900, 12, 31), 0.5, "INFERRED"), (dt.date(1900, 3, 1), dt.date(1900, 3, 31), 0.3, "METADATA")])
        known = {p: (DAY, DAY + dt.timedelta(rng.randrange(300)), 0.6, "INFERRED") for p in paths if rng.random() < rate / 3}
        if c % 3 == 0:  # bounds that are open on a side, so that children contradict each other
            day = lambda: DAY + dt.timedelta(rng.randrange(300))
            known |= {p: rng.choice([(day(), None, 0.4, "INFERRED"), (None, day(), 0.7, "INFERRED")]) for p in paths if rng.random() < 0.5}
        openings.append({p: g for p, g in known.items() if None in g})
        want[c] = plain(nodes, on, range(1, 7), prior, known)
        rows += [(c, p, "section" if p in inner else "p", None if p in inner else f"{d}" if d else "text") for p, (_, d) in nodes.items()]
        spots += [(c, nodes[p][0], n) for p, ns in on.items() for n in ns]
        numbers += [(c, n) for n in range(1, 7)]
        priors.append((c, "1900" if prior and prior[3] == "INFERRED" else "nonsense", "1900-03" if prior else None))
        guesses += [(c, nodes[p][0], *g[:3]) for p, g in known.items()]
    make = spark.createDataFrame
    plan = snapshot.planned(make(rows, "content_id int, path string, tag string, text string"))
    args = [make(spots, "content_id int, nid int, page int"), make(numbers, "content_id int, number int"), make(priors, "content_id int, hint string, metadata string"), make(guesses, "content_id int, nid int, lo date, hi date, conf double")]
    nodes, pages, whole = dating.dated(plan, *args)
    as_tuple = lambda d: (d.lo, d.hi, round(d.conf, 2), d.source) if d else None
    got = {c: ({}, {}, None) for c in want}
    for r in nodes.collect():
        got[r.content_id][0][r.path] = as_tuple(r.date)
    for r in pages.collect():
        got[r.content_id][1][r.number] = as_tuple(r.date)
    for r in whole.collect():
        got[r.content_id] = (*got[r.content_id][:2], as_tuple(r.date))
    for c in want:
        assert got[c] == want[c], c
    assert any(known and span([known[p] for p in known]) is None for known in openings)
    assert dating.dated(plan.limit(0), *(a.limit(0) for a in args))[0].count() == 0


def test_contradictions_end_where_they_arise(spark):
    """Leaves that contradict each other leave their section undated, and it says nothing to the root."""
    rows = [(1, p, "p" if p.count(".") == 2 else "section", "text" if p.count(".") == 2 else None) for p in ("0001", "0001.0001", "0001.0001.0001", "0001.0001.0002", "0001.0002", "0001.0002.0001")]
    plan = snapshot.planned(spark.createDataFrame(rows, "content_id int, path string, tag string, text string"))
    day = dt.date.fromisoformat
    known = [(1, 3, None, day("1900-01-10"), 0.6), (1, 4, day("1900-02-01"), None, 0.6), (1, 6, day("1900-06-01"), day("1900-06-30"), 0.6)]
    made = spark.createDataFrame
    nodes, _, _ = dating.dated(plan, made([], "content_id int, nid int, page int"), made([], "content_id int, number int"), made([], "content_id int, hint string, metadata string"), made(known, "content_id int, nid int, lo date, hi date, conf double"))
    got = {r.path: (r.date.lo, r.date.hi, r.date.source) if r.date else None for r in nodes.collect()}
    assert got["0001"] == (day("1900-06-01"), day("1900-06-30"), "AGGREGATED")
    assert got["0001.0001"] == (day("1900-06-01"), day("1900-06-30"), "INHERITED") and got["0001.0001.0001"][2] == "INFERRED"
