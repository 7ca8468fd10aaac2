"""SQL that thins, labels and follows the strokes of images by itself, for the queries over shapes.

An image is a list of 900 cells, the 28 x 28 pixels within a border of background; the cell after is to the east, the one
30 cells on to the south. Recursion runs over passes of whole images: thinning until two passes in a row change nothing,
then one corner at a time in scan order, and labels that take their neighbours' least label until nothing changes."""

from __future__ import annotations

from featurelab.sources import glyphs

_N, _E, _S, _W = -30, 1, 30, -1
_ROUND = (_N, _N + _E, _E, _S + _E, _S, _S + _W, _W, _N + _W)  # clockwise from the north


def _at(step: int, cells: str = "m") -> str:
    return f"{cells}[i {'+' if step >= 0 else '-'} {abs(step)}]"


def cells_sql(inverted: bool = False) -> str:
    """``cells`` (image_id, m): 1 for the pixels of at least a half, or of less with ``inverted`` (the border is 0)."""
    on = "v < 0.5" if inverted else "v >= 0.5"
    return f"""{glyphs.glyph_sql()},
cells AS (SELECT image_id, list(CASE WHEN {on} THEN 1 ELSE 0 END ORDER BY i) AS m FROM (
  SELECT e.vec_id AS image_id, i, v FROM embeddings e CROSS JOIN (SELECT unnest(range(900)) AS i) LEFT JOIN px ON px.image_id = e.vec_id AND px.r = i // 30 - 1 AND px.c = i % 30 - 1) GROUP BY image_id)"""


def skeleton_sql() -> str:
    """``skeleton`` (image_id, m) of ``cells``."""
    count = " + ".join(_at(s) for s in _ROUND)
    changes = " + ".join(f"CASE WHEN {_at(a)} = 0 AND {_at(b)} = 1 THEN 1 ELSE 0 END" for a, b in zip(_ROUND, (*_ROUND[1:], _ROUND[0])))
    first = f"{_at(_N)} * {_at(_E)} * {_at(_S)} = 0 AND {_at(_E)} * {_at(_S)} * {_at(_W)} = 0"
    second = f"{_at(_N)} * {_at(_E)} * {_at(_W)} = 0 AND {_at(_N)} * {_at(_S)} * {_at(_W)} = 0"
    gone = f"m[i] = 1 AND ({count}) BETWEEN 2 AND 6 AND ({changes}) = 1 AND CASE WHEN pass % 2 = 0 THEN {first} ELSE {second} END"
    corner = f"m[i] = 1 AND ({count}) = 2 AND {_at(_N)} + {_at(_S)} = 1 AND {_at(_E)} + {_at(_W)} = 1"
    return f"""thinning AS (SELECT image_id, 0 AS pass, 0 AS quiet, m FROM cells UNION ALL
  SELECT image_id, pass + 1, CASE WHEN n = m THEN quiet + 1 ELSE 0 END, n FROM (
    SELECT image_id, pass, quiet, m, list_transform(range(1, 901), lambda i: CASE WHEN {gone} THEN 0 ELSE m[i] END) AS n FROM thinning WHERE quiet < 2)),
corners AS (SELECT image_id, 0 AS last, m FROM thinning WHERE quiet = 2 UNION ALL
  SELECT image_id, n, list_transform(range(1, 901), lambda i: CASE WHEN i = n THEN 0 ELSE m[i] END) FROM (
    SELECT image_id, m, list_min(list_filter(range(1, 901), lambda i: i > last AND {corner})) AS n FROM corners) WHERE n IS NOT NULL),
skeleton AS (SELECT image_id, arg_max(m, last) AS m FROM corners GROUP BY image_id)"""


def graph_sql() -> str:
    """``edges`` (image_id, p, q) of the skeleton's pixels, both ways; a diagonal needs both cells at its corner off.
    ``stand`` (image_id, p, s): the least pixel of a cluster of junctions for each of its pixels. ``links`` (image_id, p, q):
    edges between clusters and other pixels, both ways, each once."""
    sides = {_N + _E: (_N, _E), _S + _E: (_S, _E), _S + _W: (_S, _W), _N + _W: (_N, _W)}
    off = {s: "".join(f" AND {_at(side)} = 0" for side in sides.get(s, ())) for s in _ROUND}
    reach = " UNION ALL ".join(f"SELECT image_id, i AS p, i + ({s}) AS q FROM pixel WHERE {_at(s)} = 1{off[s]}" for s in _ROUND)
    return f"""pixel AS (SELECT image_id, i, m FROM (SELECT image_id, m, unnest(range(1, 901)) AS i FROM skeleton) WHERE m[i] = 1),
edges AS ({reach}),
degree AS (SELECT x.image_id, x.i AS p, count(e.q) AS d FROM pixel x LEFT JOIN edges e ON e.image_id = x.image_id AND e.p = x.i GROUP BY x.image_id, x.i),
junction AS (SELECT image_id, p FROM degree WHERE d >= 3),
near AS (SELECT e.* FROM edges e SEMI JOIN junction a ON e.image_id = a.image_id AND e.p = a.p SEMI JOIN junction b ON e.image_id = b.image_id AND e.q = b.p),
together AS (SELECT image_id, p, p AS s FROM junction UNION SELECT t.image_id, n.q, t.s FROM together t JOIN near n ON n.image_id = t.image_id AND n.p = t.p),
cluster AS (SELECT image_id, p, min(s) AS s FROM together GROUP BY image_id, p),
stand AS (SELECT d.image_id, d.p, coalesce(c.s, d.p) AS s FROM degree d LEFT JOIN cluster c ON c.image_id = d.image_id AND c.p = d.p),
links AS (SELECT DISTINCT e.image_id, a.s AS p, b.s AS q FROM edges e JOIN stand a ON a.image_id = e.image_id AND a.p = e.p JOIN stand b ON b.image_id = e.image_id AND b.p = e.q WHERE a.s <> b.s)"""


_ANGLE = "atan2(CAST((({1}) - 1) // 30 - (({0}) - 1) // 30 AS DOUBLE), CAST((({1}) - 1) % 30 - (({0}) - 1) % 30 AS DOUBLE))"
_BIN = "CAST(floor((({0}) + 2 * pi()) % (2 * pi()) * 8 / (2 * pi()) + 1e-9) AS INTEGER) % 8"  # whole eighths are in the bin that they begin


def pairs_sql() -> str:
    """``pairs`` (image_id, a, b): angles of two links in succession along a path, round its end too if that is where it
    began. Paths are followed from their lesser end; back to one pixel, from its lesser neighbour; loops from their least
    pixel."""
    return f"""ends AS (SELECT image_id, p, count(*) AS d, min(q) AS f FROM links GROUP BY image_id, p),
hops AS (SELECT l.image_id, l.p, l.q, e.d FROM links l JOIN ends e ON e.image_id = l.image_id AND e.p = l.p),
along AS (SELECT image_id, p, p AS s FROM ends WHERE d = 2 UNION SELECT a.image_id, h.q, a.s FROM along a JOIN hops h ON h.image_id = a.image_id AND h.p = a.p AND h.d = 2),
loops AS (SELECT image_id, s FROM along JOIN ends USING (image_id, p) GROUP BY image_id, s HAVING min(p) = s AND min(d) = 2 AND max(d) = 2),
walk AS (SELECT image_id, p AS s, q AS f, 1 AS k, p AS u, q AS x FROM hops WHERE d <> 2
  UNION ALL SELECT l.image_id, e.p, e.f, 1, e.p, e.f FROM loops l JOIN ends e ON e.image_id = l.image_id AND e.p = l.s
  UNION ALL SELECT w.image_id, w.s, w.f, w.k + 1, w.x, h.q FROM walk w JOIN hops h ON h.image_id = w.image_id AND h.p = w.x AND h.d = 2 AND h.q <> w.u WHERE w.x <> w.s),
whole AS (SELECT image_id, s, f, max(k) AS n, arg_max(x, k) AS last, arg_max(u, k) AS before FROM walk GROUP BY image_id, s, f),
steps AS (SELECT w.image_id, w.s, w.f, w.k, n, last = w.s AND n > 1 AS closed, {_ANGLE.format('w.u', 'w.x')} AS angle FROM walk w
  JOIN whole o ON o.image_id = w.image_id AND o.s = w.s AND o.f = w.f WHERE w.s < last OR (w.s = last AND w.f < before)),
pairs AS (SELECT x.image_id, x.angle AS a, y.angle AS b FROM steps x JOIN steps y ON x.image_id = y.image_id AND x.s = y.s AND x.f = y.f AND (y.k = x.k + 1 OR (x.closed AND x.k = x.n AND y.k = 1)))"""


def shares_sql(bins: str, size: int) -> str:
    """Each image's share of ``bins`` (a query of image_id, bin), zeros too."""
    return f"""counted AS (SELECT image_id, bin, count(*) AS n FROM ({bins}) GROUP BY image_id, bin), total AS (SELECT image_id, sum(n) AS n FROM counted GROUP BY image_id)
SELECT e.vec_id AS image_id, CAST(k.bin AS INTEGER) AS bin, round(CASE WHEN t.n > 0 THEN coalesce(c.n, 0)::DOUBLE / t.n::DOUBLE ELSE 0 END, 6) AS share
FROM embeddings e CROSS JOIN (SELECT unnest(range({size})) AS bin) k LEFT JOIN total t ON t.image_id = e.vec_id LEFT JOIN counted c ON c.image_id = e.vec_id AND c.bin = k.bin"""


def ends_sql() -> str:
    return f"""WITH RECURSIVE {cells_sql()}, {skeleton_sql()}, {graph_sql()}
SELECT e.vec_id AS image_id, CAST((SELECT count(*) FROM degree d WHERE d.image_id = e.vec_id AND d.d = 1) AS INTEGER) AS endpoints,
  CAST((SELECT count(DISTINCT s) FROM cluster c WHERE c.image_id = e.vec_id) AS INTEGER) AS junctions FROM embeddings e"""


def directions_sql() -> str:
    return f"WITH RECURSIVE {cells_sql()}, {skeleton_sql()}, {graph_sql()}, " + shares_sql(f"SELECT image_id, {_BIN.format(_ANGLE.format('p', 'q'))} AS bin FROM links", 8)


def transitions_sql() -> str:
    both = f"SELECT image_id, {_BIN.format('a')} AS a, {_BIN.format('b')} AS b FROM pairs"
    bins = f"SELECT image_id, a * 8 + b AS bin FROM ({both}) UNION ALL SELECT image_id, (b + 4) % 8 * 8 + (a + 4) % 8 FROM ({both})"
    return f"WITH RECURSIVE {cells_sql()}, {skeleton_sql()}, {graph_sql()}, {pairs_sql()}, " + shares_sql(bins, 64)


def turns_sql() -> str:
    around = "(b - a + pi()) % (2 * pi())"
    turn = f"CASE WHEN {around} < 0 THEN {around} + 2 * pi() ELSE {around} END - pi()"  # not rounded: turns of whole eighths fall on either side
    of = lambda sign: f"SELECT image_id, CAST(floor(({sign}({turn}) + pi()) * 8 / (2 * pi())) AS INTEGER) % 8 AS bin FROM pairs"
    return f"WITH RECURSIVE {cells_sql()}, {skeleton_sql()}, {graph_sql()}, {pairs_sql()}, " + shares_sql(f"{of('')} UNION ALL {of('-')}", 8)


def regions_sql(inverted: bool = False) -> str:
    """Regions of lit cells over 8 neighbours, and of the others over 4 that don't touch the border: cells take the least
    number of their region, step by step, and a region counts at the cell whose number it has."""

    def least(of: int, steps: tuple[int, ...]) -> str:
        near = ", ".join(f"CASE WHEN {_at(s)} = {of} THEN {_at(s, 'n')} END" for s in steps)
        return f"CASE WHEN m[i] = {of} THEN least(n[i], {near}) ELSE n[i] END"

    inner = "i % 30 BETWEEN 2 AND 29 AND i BETWEEN 31 AND 870"  # the 28 x 28 pixels
    step = f"CASE WHEN NOT ({inner}) THEN n[i] WHEN m[i] = 1 THEN {least(1, _ROUND)} ELSE {least(0, (_N, _E, _S, _W))} END"
    return f"""WITH RECURSIVE {cells_sql(inverted)},
labels AS (SELECT image_id, m, list_transform(range(1, 901), lambda i: CASE WHEN m[i] = 0 AND (NOT ({inner}) OR i % 30 IN (2, 29) OR i < 60 OR i > 840) THEN 0 ELSE i END) AS n, false AS done FROM cells UNION ALL
  SELECT image_id, m, o, o = n FROM (SELECT image_id, m, n, list_transform(range(1, 901), lambda i: {step}) AS o FROM labels WHERE NOT done))
SELECT image_id, CAST(len(list_filter(range(1, 901), lambda i: m[i] = 1 AND n[i] = i)) AS INTEGER) AS components,
  CAST(len(list_filter(range(1, 901), lambda i: m[i] = 0 AND n[i] = i)) AS INTEGER) AS holes FROM labels WHERE done"""
