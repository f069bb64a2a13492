"""Deeply nested JSON as related flat tables, without parsing row by row.

A batch of JSON texts is one Arrow buffer. ``structure`` finds the tokens of the whole buffer
with array operations: strings by quote parity, nesting by a running sum, the parent of each
token by a search among the openers one level up, its place in the parent by a running count.
Sorted by level, the children of one parent stand together, so the parents' list offsets are
the group bounds, and paths and keys travel from parents to children by ``take``. The same
arrays decide whether a text is one whole value of strict JSON.

Strings that hold a JSON object or array are decoded together and indexed as the next batch,
at the path of the string, as often as they are encoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJ, ARR, OBJ_END, ARR_END, COMMA, COLON, STR, SCALAR = range(1, 9)
_CLASS = np.full(256, SCALAR, np.uint8)
for _c, _k in zip(b"{[}],:", (OBJ, ARR, OBJ_END, ARR_END, COMMA, COLON), strict=True):
    _CLASS[_c] = _k
_CLASS[list(b" \t\n\r")] = 0
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_SCALAR = r"^(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)\z"

SCHEMA = "row_id string, node_path string, kind string, parent_path string, position int, attributes map<string,string>"


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The pieces ``data[start:end]`` as one string array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _decode(raw: pa.Array) -> pa.Array:
    """The contents of JSON strings, given between their quotes; one call for all that have escapes."""
    hard = pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False)
    if not hard.any():
        return raw
    where = np.flatnonzero(hard)
    texts = json.loads('["' + '","'.join(raw.take(pa.array(where)).to_pylist()) + '"]', strict=False)
    out = raw.to_pylist()
    for i, t in zip(where.tolist(), texts, strict=True):
        out[i] = t.encode("utf-8", "replace").decode("utf-8")  # lone surrogates can't be stored
    return pa.array(out, pa.large_string())


def structure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Tokens of the texts that are strict JSON: doc, type, start, end, level, parent, place, is_key; doc_ok by text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    base = int(offsets[0]) if n else 0
    data = np.frombuffer(raw, np.uint8, int(offsets[-1]) - base, base) if raw is not None and n and offsets[-1] > base else np.zeros(0, np.uint8)
    first = offsets[:-1] - base
    size, ok = len(data), np.ones(n, bool)
    doc_of = lambda p: np.searchsorted(first, p, "right") - 1

    def bad(docs: np.ndarray) -> None:
        ok[docs] = False

    starts = np.zeros(size + 1, bool)
    starts[first] = True
    escaped = np.zeros(size + 1, bool)
    slashes = np.flatnonzero(data == 92)
    if len(slashes):
        fresh = np.ones(len(slashes), bool)
        fresh[1:] = (np.diff(slashes) != 1) | starts[slashes[1:]]
        rank = np.arange(len(slashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))
        after = slashes[rank % 2 == 0] + 1
        after = after[~starts[after] & (after < size)]
        escaped[after] = True
        bad(doc_of(after[~_ESCAPES[data[after]]]))
        u = after[data[after] == ord("u")]
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        bad(doc_of(u[~(_HEX[padded[u + 1]] & _HEX[padded[u + 2]] & _HEX[padded[u + 3]] & _HEX[padded[u + 4]])]))
    quotes = np.flatnonzero((data == 34) & ~escaped[:size])
    qdoc = doc_of(quotes)
    count = np.bincount(qdoc, minlength=n)
    bad(np.flatnonzero(count % 2))
    rank = np.arange(len(quotes)) - (np.cumsum(count) - count)[qdoc]
    keep = ok[qdoc]
    opens, closes = quotes[keep & (rank % 2 == 0)], quotes[keep & (rank % 2 == 1)]
    edge = np.zeros(size + 1, np.int8)
    edge[opens] += 1
    edge[closes + 1] -= 1
    inside = np.cumsum(edge[:size], dtype=np.int8).astype(bool)
    bad(doc_of(np.flatnonzero(inside & (data < 32))))

    kind = np.where(inside, 0, _CLASS[data])
    other = kind == SCALAR
    before = np.zeros(size, bool)
    before[1:] = other[:-1]
    scalar_starts = other & (~before | starts[:size])
    after_it = np.zeros(size, bool)
    after_it[:-1] = other[1:] & ~starts[1:size]
    scalar_ends = np.flatnonzero(other & ~after_it) + 1
    kind[other & ~scalar_starts] = 0
    kind[opens] = STR
    pos = np.flatnonzero(kind)
    typ = kind[pos]
    doc = doc_of(pos)
    end = pos + 1
    end[typ == SCALAR] = scalar_ends
    end[typ == STR] = closes + 1 if len(closes) == int((typ == STR).sum()) else 0
    scal = np.flatnonzero(typ == SCALAR)
    if len(scal):
        fine = pc.match_substring_regex(_spans(data, pos[scal], end[scal]), _SCALAR).to_numpy(zero_copy_only=False)
        bad(doc[scal[~fine]])

    opener, closer = (typ == OBJ) | (typ == ARR), (typ == OBJ_END) | (typ == ARR_END)
    step = opener.astype(np.int64) - closer
    run = np.cumsum(step)
    head = np.ones(len(pos), bool)
    head[1:] = doc[1:] != doc[:-1]
    heads = np.flatnonzero(head)
    per = np.diff(np.append(heads, len(pos)))
    depth = run - np.repeat(run[heads] - step[heads], per)
    level = np.where(opener, depth - 1, depth)  # a closer has its opener's level, all else its own depth
    bad(doc[depth < 0])
    tail = np.append(heads[1:], len(pos)) - 1 if len(heads) else heads
    bad(doc[tail[depth[tail] != 0]])
    bad(np.setdiff1d(np.arange(n), doc))

    live = ok[doc]
    pos, typ, doc, end, level, opener, closer, head = (x[live] for x in (pos, typ, doc, end, level, opener, closer, head))
    m = len(pos)
    order = np.argsort(level, kind="stable")
    top = int(level.max()) + 1 if m else 0
    bounds = np.searchsorted(level[order], np.arange(top + 1))
    parent = np.full(m, -1)
    match = np.full(m, -1)
    openers_up = np.zeros(0, np.int64)
    for k in range(top):
        here = order[bounds[k] : bounds[k + 1]]
        plain = here[~closer[here]]
        if k:
            parent[plain] = openers_up[np.searchsorted(openers_up, plain) - 1]
        mine = here[opener[here]]
        ends = here[closer[here]]
        match[ends] = mine[np.searchsorted(mine, ends) - 1]
        match[match[ends]] = ends
        openers_up = mine
    box = np.where(closer, match, parent)  # the container a token stands in; a closer stands in what it closes
    ctx = np.where(box >= 0, typ[box] if m else 0, 0)
    prev = np.zeros(m, np.uint8)
    prev[1:] = typ[:-1]
    prev[head] = 0
    is_key = (typ == STR) & (ctx == OBJ) & ((prev == OBJ) | (prev == COMMA))
    prev_key = np.zeros(m, bool)
    prev_key[1:] = is_key[:-1]
    prev_key &= ~head
    value = opener | (typ == SCALAR) | ((typ == STR) & ~is_key)
    ended = ((prev >= OBJ_END) & (prev <= ARR_END)) | (prev >= STR)
    wrong = value & np.where(ctx == ARR, ~((prev == ARR) | (prev == COMMA)), np.where(ctx == OBJ, prev != COLON, ~head))
    wrong |= (typ == COMMA) & (~ended | prev_key | (ctx == 0))
    wrong |= (typ == COLON) & ~prev_key
    wrong |= closer & (ctx != np.where(typ == OBJ_END, OBJ, ARR))
    own = np.zeros(m, bool)
    own[1:] = match[1:] == np.arange(m - 1)
    wrong |= closer & ((~ended & ~own) | prev_key)
    bad(doc[wrong])

    place = np.full(m, -1)
    vals = np.flatnonzero(value)
    vals = vals[np.lexsort((vals, parent[vals]))]
    fresh = np.ones(len(vals), bool)
    fresh[1:] = parent[vals[1:]] != parent[vals[:-1]]
    at = np.arange(len(vals))
    place[vals] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return {"data": data, "ok": ok, "doc": doc, "type": typ, "start": pos, "end": end, "level": level, "parent": parent, "place": place, "value": value}


def flatten_batch(ids: pa.Array, texts: pa.Array, attributes: bool = True, every: bool = False) -> pa.Table:
    """Rows of ``SCHEMA`` for every object that is an element of an array, at any depth; with ``every`` see ``flatten_json``."""
    row = np.arange(len(texts))
    path = pa.array(["$"] * len(texts), pa.large_string())
    node = pa.nulls(len(texts), pa.large_string())  # nearest object with a row above
    elem = np.full(len(texts), -1)
    origin = np.full(len(texts), -1)  # of a decoded string its number among the plain values; it is none if it holds an object or array
    plain_rows: list[pa.Table] = []
    n_plain = 0
    opened: list[np.ndarray] = []
    out: list[pa.Table] = []
    n_rounds = 0
    while len(texts):
        s = structure(texts)
        typ, parent, place = s["type"], s["parent"], s["place"]
        ok = s["ok"][s["doc"]]
        data, doc, level = s["data"], s["doc"], s["level"]
        m = len(typ)
        holder = np.where(parent >= 0, typ[parent] if m else 0, 0)
        in_arr, in_obj = s["value"] & (holder == ARR) & ok, s["value"] & (holder == OBJ) & ok
        first_byte = np.zeros(m, np.uint8)
        text_at = np.flatnonzero((typ == STR) & s["value"] & ok & (s["end"] - s["start"] > 3))
        first_byte[text_at] = data[s["start"][text_at] + 1]
        coded = np.isin(first_byte, np.frombuffer(b'{[\\ \t\n\r', np.uint8)) & (typ == STR)
        want = ok & s["value"] & ((typ == OBJ) | (typ == ARR) | coded)
        plain = np.flatnonzero(((typ == STR) | (typ == SCALAR)) & (in_arr | ((level == 0) & s["value"] & ok & (not n_rounds)))) if every else np.zeros(0, np.int64)
        want[plain] = True
        paths = np.empty(m, object)
        above = np.empty(m, object)
        base_path, base_node = np.asarray(path.to_pylist(), object), np.asarray(node.to_pylist(), object)
        place_of = np.where(holder == ARR, place, -1)
        tokens = np.flatnonzero(want)
        named = tokens[in_obj[tokens]]
        keys = np.empty(m, object)
        keys[named] = _decode(_spans(data, s["start"][named - 2] + 1, s["end"][named - 2] - 1)).to_pylist()
        for k in range(int(level[tokens].max()) + 1 if len(tokens) else 0):
            here = tokens[level[tokens] == k]
            if not k:
                paths[here], above[here] = base_path[doc[here]], base_node[doc[here]]
                place_of[here] = elem[doc[here]]
                continue
            up = parent[here]
            arr = holder[here] == ARR
            tail = np.empty(len(here), object)
            tail[arr] = np.char.add(np.char.add("[", place[here][arr].astype(str)), "]").astype(object)
            tail[~arr] = "." + keys[here[~arr]]
            paths[here] = paths[up] + tail
            is_node = (typ[up] == OBJ) & (every | (place_of[up] >= 0))
            above[here] = np.where(is_node, paths[up], above[up])
        hits = tokens[(typ[tokens] == OBJ) & (every | (place_of[tokens] >= 0))]
        if len(hits):
            found = pa.array(paths[hits], pa.large_string())
            cols = {
                "row_id": ids.take(pa.array(row[doc[hits]])).cast(pa.string()),
                "node_path": found.cast(pa.string()),
                "kind": pc.replace_substring_regex(found, r"\[[0-9]+\]", "[]").cast(pa.string()),
                "parent_path": pa.array(above[hits], pa.string()),
                "position": pc.if_else(pa.array(place_of[hits] >= 0), pa.array(place_of[hits], pa.int32()), None),
                "attributes": _attributes(s, hits, in_obj) if attributes else pa.nulls(len(hits), pa.map_(pa.string(), pa.string())),
            }
            out.append(pa.table(cols | {"value": pa.nulls(len(hits), pa.string())} if every else cols))
        number = np.full(m, -1)
        if every:
            roots = tokens[level[tokens] == 0]
            number[roots] = origin[doc[roots]]
            opened.append(number[roots[typ[roots] < OBJ_END]])
            number[plain] = n_plain + np.arange(len(plain))
            n_plain += len(plain)
        if len(plain):
            found = pa.array(paths[plain], pa.large_string())
            cols = {
                "row_id": ids.take(pa.array(row[doc[plain]])).cast(pa.string()),
                "node_path": found.cast(pa.string()),
                "kind": pc.replace_substring_regex(found, r"\[[0-9]+\]", "[]").cast(pa.string()),
                "parent_path": pa.array(above[plain], pa.string()),
                "position": pc.if_else(pa.array(place_of[plain] >= 0), pa.array(place_of[plain], pa.int32()), None),
                "attributes": pa.nulls(len(plain), pa.map_(pa.string(), pa.string())),
                "value": _values(s, plain).cast(pa.string()),
            }
            plain_rows.append(pa.table(cols))
        n_rounds += 1
        deeper = tokens[coded[tokens]]
        if not len(deeper):
            break
        texts = _decode(_spans(data, s["start"][deeper] + 1, s["end"][deeper] - 1))
        path, node = pa.array(paths[deeper], pa.large_string()), pa.array(above[deeper], pa.large_string())
        row, elem, origin = row[doc[deeper]], place_of[deeper], number[deeper]
    if n_plain:
        shut = np.ones(n_plain, bool)
        gone = np.concatenate(opened)
        shut[gone[gone >= 0]] = False
        out.append(pa.concat_tables(plain_rows).filter(pa.array(shut)))
    return pa.concat_tables(out) if out else pa.table({f: pa.array([], t) for f, t in [*_ARROW, *[("value", pa.string())] * every]})


_ARROW = [("row_id", pa.string()), ("node_path", pa.string()), ("kind", pa.string()), ("parent_path", pa.string()), ("position", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))]


def _values(s: dict[str, np.ndarray], leaf: np.ndarray) -> pa.Array:
    """The strings and scalars ``leaf`` as text; a JSON null is null."""
    string = s["type"][leaf] == STR
    raw = _spans(s["data"], s["start"][leaf] + string, s["end"][leaf] - string)
    is_null = pc.and_(pc.equal(raw, "null"), pa.array(~string))
    return pc.if_else(is_null, pa.scalar(None, pa.large_string()), _decode(raw))


def _attributes(s: dict[str, np.ndarray], hits: np.ndarray, in_obj: np.ndarray) -> pa.Array:
    """The scalar and string members of the objects ``hits``; of repeated names the last, as maps hold one."""
    typ, parent = s["type"], s["parent"]
    rank = np.full(len(typ), -1)
    rank[hits] = np.arange(len(hits))
    leaf = np.flatnonzero(in_obj & ((typ == STR) | (typ == SCALAR)))
    leaf = leaf[rank[parent[leaf]] >= 0]
    leaf = leaf[np.argsort(rank[parent[leaf]], kind="stable")]
    keys = _decode(_spans(s["data"], s["start"][leaf - 2] + 1, s["end"][leaf - 2] - 1))
    vals = _values(s, leaf)
    owner = rank[parent[leaf]]
    code = pc.dictionary_encode(keys).indices.to_numpy()
    pair = owner.astype(np.int64) * (int(code.max()) + 1 if len(code) else 1) + code
    last = np.sort(len(pair) - 1 - np.unique(pair[::-1], return_index=True)[1]) if len(pair) else np.zeros(0, np.int64)
    offsets = np.searchsorted(owner[last], np.arange(len(hits) + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), keys.take(pa.array(last)).cast(pa.string()), vals.take(pa.array(last)).cast(pa.string()))


def flatten_json(df: DataFrame, json_column: str, id_column: str = "id", attributes: bool = True, every: bool = False) -> DataFrame:
    """Every object that is an array element in ``json_column``, as rows of ``SCHEMA``.

    ``row_id`` is the parent row's id and ``node_path`` the place in it; ``kind`` is the path
    without positions (one flat table per kind, see ``child_table``); ``parent_path`` is the path of
    the nearest object element above (null: the row itself) and ``position`` the place in the array,
    nulls counted. ``attributes`` holds the object's scalar and string members.

    With ``every``, all else that the texts hold has rows too, with a column ``value``: objects that are members
    or the root (``position`` is null, and they count as objects above), and the strings and scalars that are elements
    of an array or the root, whose ``value`` is their text (null for a JSON null) and whose ``attributes`` are null.

    A text that is null, blank or not one whole value of strict JSON has no rows. Exact copies of
    a row give copies of its nodes; an empty table gives none. Other columns are not read.
    """
    rows = df.select(F.col(id_column).cast("string").alias("row_id"), F.col(json_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b.column(0), b.column(1), attributes, every).to_batches()

    if every:
        return rows.where("text is not null").mapInArrow(run, SCHEMA + ", value string")
    # text that holds no array or no object, even inside a string, has no such element
    return rows.where(F.col("text").contains("[") | F.col("text").contains("\\u005")).mapInArrow(run, SCHEMA)


def child_table(nodes: DataFrame, kind: str | Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The flat table of one kind of child: row_id, node_path, parent_path, position and typed ``columns``.

    Several kinds make one table where a column comes in several shapes. A member that is absent, null or of
    another type is null.
    """
    return nodes.where(F.col("kind").isin(*([kind] if isinstance(kind, str) else kind))).select(
        "row_id",
        "node_path",
        "parent_path",
        "position",
        *[F.col("attributes")[name].try_cast(t).alias(name) for name, t in columns.items()],
    )
