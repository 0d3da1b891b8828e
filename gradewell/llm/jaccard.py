"""N-gram Jaccard join by prefix trees (operator 9).

A document's set holds its distinct word n-grams (A-Z folded; a text of fewer
words is one n-gram). Two documents link when 100 * |intersection| >= percent *
|union|. The result is one row per document with its class (connected component).

* One token per n-gram is also its place in an order that all sets share: four bits of
  length (long words first, as n-grams of short words are often shared by
  chance), then 54 hash bits. For the groups, the first n-grams in the order of length, a share of
  ``COUNTED`` times what a set can differ by, are put in the order of their exact counts
  over all sets, rare ones first; the others follow uncounted. So the counting shuffle
  carries that share only, and shared passages stand late.
* Equal sets are one class by a 128-bit sum; one member stands for the class.
* Two sets that link share a token among their first n - ceil(percent * n / 100) + 1.
  Sets that share such a token meet in its group. There a screen goes first: every set has
  the parities of its tokens' counts in a number of cells that follows its size. Cells whose
  parities differ hold at least one token each that only one of two sets has, so pairs with more
  such cells than their sizes allow can't link; the others do with few exceptions. What screens
  connect over all groups is a family; a set travels whole only if it is in one, and once.
* Each family is a trie of ordered sets (long words first, then by hash), kept as the sorted sets and their common
  prefixes. One walk in order serves all sets of the family as queries: a run that sets share
  is counted once, for all queries at a time, and a subtree loses those queries that the
  remaining lengths keep from the overlap that its smallest set would need. Sets that already
  hang together are not compared, so m near copies cost about m steps and emit m - 1 links.
* Two rounds: the first joins the groups of each set's rarest shared token, which makes
  most families one component. The second goes through all groups where components still meet,
  and screens out pairs of one component.
* A token group of more than ``block`` sets is dealt into blocks by salt. The first round joins
  within blocks; then one set of each component and block meets the others, again and
  again until one block holds them. In the second round every pair of blocks meets where components
  still differ, so no pair is lost. A family of more than ``WHOLE`` bytes is cut, and every
  pair of its cuts meets; so a task holds two blocks of screens, or two cuts of sets, at a time.

Defined cases: null, empty or blank text has the empty set, n_shingles 0 and its own
doc_id as component; repeated rows give repeated result rows; rows that share a
doc_id but not the set are linked by their own sets only; a null doc_id gets its class's
smallest id, or null where no row of its class has one, and such rows keep only to their
equals; further columns are ignored. Chances of a wrong verdict by a 54-bit clash: about
2^-36 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import Bitmap, bitmap, components, cut, discard, documents, partitions, store

BLOCK = 8192       # sets of one token that one task screens
WHOLE = 8 << 20    # bytes of whole sets in a cut of a family
CELLS = 1 << 24    # of the table of queries and shared tokens that a walk holds
LONGEST_SKETCH = 1 << 14


COUNTED = 1.6
HASH = np.uint64((1 << 58) - 1)


def _lengths(start, end, woff, n: int):
    """Length class, 0 to 15 (0: longest words), of the n-grams in the order of K.ngrams."""
    upto = np.concatenate(([0], np.cumsum(end - start)))
    cnt = np.diff(woff)
    out = np.where(cnt >= n, cnt - n + 1, (cnt > 0).astype(cnt.dtype))
    first = K.ragged(woff[:-1], out)
    last = np.minimum(first + n, np.repeat(woff[1:], out))
    return 15 - np.minimum((upto[last] - upto[first]) * 3 // (2 * (last - first)), 15)


def _sets(text_column, n: int):
    """(58 bits of length class and hash, offsets) of the documents' sets, each in ascending order."""
    data, off = K.buffer(text_column)
    start, end, h, woff = K.words(data, off)
    val, goff = K.ngrams(h, woff, n)
    val = (val >> np.uint64(10)) | (_lengths(start, end, woff, n).astype(np.uint64) << np.uint64(54))
    for a, b in zip(goff[:-1].tolist(), goff[1:].tolist()):
        val[a:b].sort()
    if len(val) == 0:
        return val, goff
    fresh = np.empty(len(val), bool)
    fresh[0] = True
    fresh[1:] = val[1:] != val[:-1]
    fresh[goff[:-1][np.diff(goff) > 0]] = True
    return val[fresh], np.concatenate(([0], np.cumsum(fresh)))[goff]


def _count_lengths(n: int):
    def run(batches):
        total = np.zeros(16, np.int64)
        for b in K.slices(batches, 1 << 20):
            data, off = K.buffer(b.column("text"))
            start, end, _, woff = K.words(data, off)
            total += np.bincount(_lengths(start, end, woff, n), minlength=16)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16)), pa.array(total)], ["k", "c"])
    return run


def front(docs: DataFrame, n: int, percent: int) -> int:
    """The hashes below this are counted: the share COUNTED * (1 - percent / 100) of all n-grams."""
    rows = docs.select("text").mapInArrow(_count_lengths(n), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    count = {r["k"]: r["c"] for r in rows}
    left = COUNTED * (1 - percent / 100) * sum(count.values())
    for k in range(16):
        c = count.get(k, 0)
        if c and left < c:
            return (k << 54) + int((1 << 54) * left / c)
        left -= c
    return 16 << 54


def _prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _apart(size, percent: int):
    """Most tokens that are in one set only, of two that link and have ``size`` tokens together."""
    return size - 2 * -(-percent * size // (100 + percent))


def _cells(n: np.ndarray, percent: int) -> np.ndarray:
    """Cells of a set's sketch: a power of two, eight times or more what an equally large set may differ by."""
    want = np.maximum(16 * n * (100 - percent) // (100 + percent), 64)
    return np.minimum(1 << np.ceil(np.log2(want)).astype(np.int64), LONGEST_SKETCH)


def _sketches(val: np.ndarray, off: np.ndarray, percent: int) -> pa.Array:
    """Parities of the tokens' counts in the cells of each set, as bits."""
    size = np.diff(off)
    cells = np.where(size > 0, _cells(size, percent), 0)
    first = np.concatenate(([0], np.cumsum(cells)))
    cell = (K.mix(val ^ K.ORDER[59]) & (np.repeat(cells, size) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(first[:-1], size) + cell, minlength=int(first[-1])).astype(np.uint8) & 1
    raw = np.packbits(odd, bitorder="little").tobytes()
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(raw)])


def _prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _sums(val: np.ndarray, off: np.ndarray):
    """A 128-bit sum of each set, as two numbers."""
    for salt in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(val ^ K.ORDER[60 + salt]))))
        yield (total[off[1:]] - total[off[:-1]]).view(np.int64)


def _signatures(n: int, percent: int, below: int):
    def run(batches):
        limit = np.uint64(below)
        for b in K.slices(batches, 1 << 20):
            val, off = _sets(b.column("text"), n)
            size = np.diff(off)
            counted = np.diff(np.concatenate(([0], np.cumsum(val < limit)))[off])
            p = np.where(size > 0, np.maximum(_prefix_size(size, percent), counted), 0)
            head = K.string_list(val[K.ragged(off[:-1], p)].view(np.int64), np.concatenate(([0], np.cumsum(p))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(size.astype(np.int64)), *map(pa.array, _sums(val, off)),
                                              pa.array(counted.astype(np.int64)), head, _sketches(val, off, percent)], HEADS)
    return run


HEADS = ["doc_id", "t", "n", "s1", "s2", "counted", "head", "sketch"]


def _maybe_shared(shared: Bitmap):
    """(node, token, place among the first tokens) of those that may be shared."""
    def run(batches):
        for b in batches:
            lists = b.column("head")
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            ok = np.flatnonzero(shared(token.view(np.uint64)))
            at = K.ragged(np.zeros(len(size), np.int64), size)[ok]
            node = np.repeat(b.column("node").to_numpy(), size)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(token[ok]), pa.array(at.astype(np.int32))], ["node", "token", "at"])
    return run


def _classes(val: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Places in the order of counted hashes that m sets share."""
    return ((1 + np.minimum(4 * np.log2(m), 60)).astype(np.uint64) << np.uint64(58)) | val


def _places(percent: int, block: int, below: int):
    """The groups of each set, in the order of its tokens: the shared ones of its first tokens, each with
    its number of blocks and the set's own."""
    def run(batches):
        for b in batches:
            rows = []
            for node, n, counted, known in zip(*(b.column(k).to_pylist() for k in ("node", "n", "counted", "known"))):
                h = np.array([k["token"] for k in known], np.int64).view(np.uint64)
                m = np.array([k["m"] for k in known], np.int64)
                own = h < np.uint64(below)
                first = np.sort(_classes(h[own], m[own].astype(np.float64)))
                left = _prefix_size(n, percent) - (counted - len(first))  # unique ones come before
                if left <= 0:
                    continue
                token = first[:left].view(np.int64).tolist()
                token += sorted(k["token"] for k in known if k["token"] >= below and k["at"] < _prefix_size(n, percent))
                count = {k["token"]: k["m"] for k in known}
                for i, t in enumerate(token):
                    blocks = -(-count[t & int(HASH)] // block)
                    salt = int(K.mix(np.array([node ^ t], np.int64).view(np.uint64))[0] % np.uint64(blocks)) if blocks > 1 else 0
                    rows.append((t, node, i, blocks, salt))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 5], PLACE)
    return run


PLACE = ["token", "node", "i", "blocks", "salt"]


def _wanted(wanted: Bitmap):
    """The documents whose texts may be wanted."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(wanted(b.column("t").to_numpy().view(np.uint64))))
    return run


def _members(n: int):
    """Each set, once for every cut of its family that it goes to."""
    def run(batches):
        for b in K.slices(batches, 1 << 20):
            val, off = _sets(b.column("text"), n)
            raw, own = val.tobytes(), b.column("cuts")
            times = np.diff(own.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), times)
            for a in range(0, len(row), 500):
                part = row[a:a + 500]
                at = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column("family").take(at), own.flatten().slice(a, 500), b.column("node").take(at), b.column("comp").take(at),
                     pa.array([raw[8 * off[i]:8 * off[i + 1]] for i in part.tolist()], pa.binary())], MEMBER)
    return run


MEMBER = ["family", "cut", "node", "comp", "tokens"]


def _folded(raw: bytes, cells: int) -> np.ndarray:
    """A sketch as words, brought down to ``cells`` cells."""
    w = np.frombuffer(raw, np.uint64)
    while len(w) * 64 > cells:
        w = w[:len(w) // 2] ^ w[len(w) // 2:]
    return w


def close_pairs(n: np.ndarray, sketches: list, percent: int):
    """(i, j's) of sets, given in the order of their sizes, that their sketches let link; i < j."""
    cells = _cells(n, percent)
    for c in np.unique(cells):
        a, b = np.searchsorted(cells, (c, c + 1))
        top = int(np.searchsorted(n, 100 * n[b - 1] // percent, "right"))
        words = np.stack([_folded(x, int(c)) for x in sketches[a:top]])
        step = max(1, (1 << 21) // max(1, words[0].size * (top - a)))
        for x in range(a, b, step):
            y = min(x + step, b)
            to = int(np.searchsorted(n, 100 * n[y - 1] // percent, "right"))
            differ = np.bitwise_count(words[x - a:y - a, None] ^ words[None, x - a:to - a]).sum(axis=2, dtype=np.int64)
            ok = differ <= _apart(n[x:y, None] + n[None, x:to], percent)
            for i in range(x, y):
                js = np.flatnonzero(ok[i - x, i - x + 1:]) + i + 1
                if len(js):
                    yield i, js


def screened(n, sketches: list, comps, percent: int):
    """Numbers of the sets that may link with one of another component, in lists of sets that may hang together."""
    order = np.argsort(n, kind="stable")
    n, comps, sketches = np.asarray(n, np.int64)[order], np.asarray(comps)[order], [sketches[i] for i in order]
    label, hit = np.arange(len(n)), np.zeros(len(n), bool)
    for i, js in close_pairs(n, sketches, percent):
        js = js[comps[js] != comps[i]]
        if len(js):
            hit[i] = True
            hit[js] = True
            own = np.unique(label[js])
            if len(own) > 1 or own[0] != label[i]:
                own = np.append(own, label[i])
                label[np.isin(label, own)] = own.min()
    at = np.flatnonzero(hit)
    at = at[np.argsort(label[at], kind="stable")]
    for part in np.split(at, np.flatnonzero(np.diff(label[at])) + 1):
        if len(part):
            yield order[part]


SMALL = 64  # sets of a group whose pairs are looked at together with those of other groups


def screened_small(first: np.ndarray, size: np.ndarray, n: np.ndarray, sketches: list, comps: np.ndarray, percent: int):
    """The same for many small groups at once, given by first row and size: (label, row), a label being a row of the same list."""
    hit = np.zeros(len(n), bool)
    edges = []
    rows = K.ragged(first, size)
    end = np.repeat(first + size, size)
    cells = _cells(n, percent)
    for a in range(0, len(rows), 2000):
        i0 = rows[a:a + 2000]
        more = end[a:a + 2000] - i0 - 1
        i, j = np.repeat(i0, more), K.ragged(i0 + 1, more)
        ok = (comps[i] != comps[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        own = np.minimum(cells[i], cells[j])
        for c in np.unique(own):
            x, y = i[own == c], j[own == c]
            used = np.unique(np.concatenate((x, y)))
            words = np.stack([_folded(sketches[k], int(c)) for k in used])
            step = max(1, (1 << 20) // words.shape[1])
            for q in range(0, len(x), step):
                u, v = x[q:q + step], y[q:q + step]
                differ = np.bitwise_count(words[np.searchsorted(used, u)] ^ words[np.searchsorted(used, v)]).sum(axis=1, dtype=np.int64)
                near = differ <= _apart(n[u] + n[v], percent)
                edges.append((u[near], v[near]))
    if not edges:
        return rows[:0], rows[:0]
    u, v = (np.concatenate(x) for x in zip(*edges))
    hit[u] = hit[v] = True
    return K.least_labels(len(n), u, v)[hit], np.flatnonzero(hit)


def _screen(percent: int):
    """(head, set): the sets that may link, with one that stands for those they may hang together with."""
    def out(rows):
        token, block, node, n, comp = (rows.column(k).to_numpy() for k in range(5))
        sketches = rows.column(5).to_pylist()
        first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (block[1:] != block[:-1]))))
        size = np.diff(np.append(first, len(token)))
        small = size <= SMALL
        label, at = screened_small(first[small], size[small], n, sketches, comp, percent)
        found = [(node[label], node[at])]
        for a, m in zip(first[~small].tolist(), size[~small].tolist()):
            for members in screened(n[a:a + m], sketches[a:a + m], comp[a:a + m], percent):
                own = node[a + members]
                found.append((np.full(len(own), own[0]), own))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["head", "node"])

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            same = (b.column(0).to_numpy() == b.column(0)[-1].as_py()) & (b.column(1).to_numpy() == b.column(1)[-1].as_py())
            closed = b.num_rows - int(same.sum())  # the last group waits for the rest of its rows
            if held and not closed and held[-1].column(0)[-1] == b.column(0)[0] and held[-1].column(1)[-1] == b.column(1)[0]:
                held.append(b)
                continue
            yield from out(pa.Table.from_batches([*held, b.slice(0, closed)]).combine_chunks())
            held = [b.slice(closed)]
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())
    return run


def _branches(common: list[int]) -> list[list[int]]:
    """Of sorted sets whose common prefixes with the one before are given: the depths, ascending,
    beyond that prefix at which later sets leave each."""
    out, stack = [[] for _ in common], []
    for i in range(len(common) - 1, -1, -1):
        while stack and stack[-1] > common[i]:
            out[i].append(stack.pop())
        out[i].reverse()
        if not stack or stack[-1] < common[i]:
            stack.append(common[i])
    return out


def trie_links(names, sets, percent: int, comps=None, chunk: int = 64):
    """Links (a, b) that join the sets of one part into its components; comps: those they are in already."""
    m = len(sets)
    order = sorted(range(m), key=lambda i: sets[i].astype(">u8").tobytes())
    names, sets = [names[i] for i in order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    token, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    off = np.concatenate(([0], np.cumsum(size)))
    columns = [column[a:b] for a, b in zip(off[:-1], off[1:])]
    width = int((times > 1).sum())
    common = [0] * m
    for i in range(1, m):
        k = min(size[i - 1], size[i])
        same = sets[i - 1][:k] == sets[i][:k]
        common[i] = int(k) if same.all() else int(np.argmin(same))
    leaves = _branches(common)
    low, high = _extremes(size, common, leaves)
    comp = np.arange(m) if comps is None else np.unique(np.asarray(comps)[order], return_inverse=True)[1]
    rows = max(1, CELLS // max(1, width))
    for a in range(0, m, rows):  # queries a .. a + rows
        own = np.arange(a, min(m, a + rows))
        has = np.zeros((len(own), width), np.uint8)
        for q in own:
            c = columns[q]
            has[q - a, c[c >= 0]] = 1
        stack = [(0, own, np.zeros(len(own), np.int64))]  # (depth, queries alive, their overlaps)
        for i in range(m):
            while stack[-1][0] > common[i]:
                stack.pop()
            depth, alive, overlap = stack[-1]
            later = (alive > i) & (comp[alive] != comp[i]) if not leaves[i] else alive > i
            alive, overlap = alive[later], overlap[later]
            for end, lo, hi in zip([*leaves[i], int(size[i])], low[i], high[i]):
                if end == size[i]:
                    later = comp[alive] != comp[i]
                    alive, overlap = alive[later], overlap[later]
                while depth < end and len(alive):
                    to = min(depth + chunk, end)
                    c = columns[i][depth:to]
                    c = c[c >= 0]
                    if len(c):
                        overlap = overlap + has[alive[:, None] - a, c[None, :]].sum(axis=1, dtype=np.int64)
                    depth = to
                    need = -(-percent * (size[alive] + lo) // (100 + percent))
                    ok = overlap + np.minimum(hi - depth, size[alive] - overlap) >= need
                    alive, overlap = alive[ok], overlap[ok]
                depth = end
                if end < size[i]:
                    stack.append((depth, alive, overlap))
            link = alive[100 * overlap >= percent * (size[alive] + size[i] - overlap)]
            for q in link:
                if comp[q] != comp[i]:
                    yield names[q], names[i]
                    comp[comp == comp[q]] = comp[i]


def _extremes(size: np.ndarray, common: list[int], leaves: list[list[int]]):
    """Smallest and largest size of the sets below each depth of ``leaves`` and of each set itself."""
    m = len(size)
    low, high = [[int(s)] for s in size], [[int(s)] for s in size]
    # from the right: of every depth at which a path is left, the sizes of what follows there
    stack: list[list[int]] = []  # (depth, smallest, largest) of the runs to the right, deepest last
    for i in range(m - 1, -1, -1):
        lo = hi = int(size[i])
        found = []
        while stack and stack[-1][0] > common[i]:
            depth, x, y = stack.pop()
            lo, hi = min(lo, x), max(hi, y)
            found.append((lo, hi))
        found.reverse()
        low[i] = [x for x, _ in found] + low[i]
        high[i] = [y for _, y in found] + high[i]
        if stack and stack[-1][0] == common[i]:
            stack[-1][1:] = [min(lo, stack[-1][1]), max(hi, stack[-1][2])]
        else:
            stack.append([common[i], lo, hi])
    return low, high


def _join(percent: int):
    def run(batches):
        key, rows = None, []
        for b in batches:
            out = []
            for family, part, *row in zip(*(b.column(k).to_pylist() for k in MEMBER)):
                if (family, part) != key:
                    out += _links(rows, percent)
                    key, rows = (family, part), []
                rows.append(row)
            yield _edges(out)
        yield _edges(_links(rows, percent))
    return run


def _links(rows: list, percent: int) -> list:
    if len(rows) < 2:
        return []
    names, comps, sets = zip(*rows)
    return list(trie_links(names, [np.frombuffer(x, np.uint64) for x in sets], percent, comps))


def _edges(found):
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class Join:
    """The links between the sets of a table ``nodes`` (node, rep, t, n, counted, sketch), whose first tokens are in ``heads``
    (node, head), over ``docs`` (doc_id, t, text)."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, heads: DataFrame, n: int, percent: int, below: int, block: int):
        self.spark, self.docs, self.nodes = docs.sparkSession, docs, nodes
        self.n, self.percent, self.block = n, percent, block
        shared = cut(heads.select(F.explode("head").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        may = bitmap(shared.select(F.col("token").alias("key")), shared.count())
        known = heads.mapInArrow(_maybe_shared(may), "node long, token long, at int").join(shared, "token")
        known = (known.groupBy("node").agg(F.collect_list(F.struct("token", "m", "at")).alias("known"))  # of one document
                 .join(nodes.select("node", "n", "counted"), "node"))
        self.places = cut(known.mapInArrow(_places(percent, block, below), "token long, node long, i long, blocks long, salt long"))

    def within(self, groups: DataFrame, once: bool) -> DataFrame:
        """Links within groups of rows (token, block, node, comp), by screens and then by tries; ``once``: a set is in
        one group at most. What screens connect, over all groups, is a family, and a set travels to its family once."""
        key = ["token", "block"]
        rows = groups.join(self.nodes.select("node", "n", "sketch"), "node").select(*key, "node", "n", "comp", "sketch")
        left = cut(rows.repartition(partitions(self.spark), *key).sortWithinPartitions(*key).mapInArrow(_screen(self.percent), "head long, node long"))
        family = (left.select("node", F.col("head").alias("family")) if once
                  else components(left, "head", "node").select("node", F.col("component").alias("family")))
        comps = groups.select("node", "comp").distinct()
        own = family.join(self.nodes.select("node", "rep", "t", "n"), "node").join(comps, "node")
        # a family of more than WHOLE bytes is cut by salt, and every pair of its cuts meets
        size = own.groupBy("family").agg(F.ceil(F.sum("n") * 8 / WHOLE).alias("of"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("of") - 1),
                            lambda o: F.least("salt", o) * F.col("of") + F.greatest("salt", o))
        wanted = cut(own.join(size, "family").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("of")))
                     .select("family", pairs.alias("cuts"), "node", "comp", F.col("rep").alias("doc_id"), "t"))
        may = bitmap(wanted.select(F.col("t").alias("key")), wanted.count())
        texts = self.docs.mapInArrow(_wanted(may), self.docs.schema).dropDuplicates(["doc_id", "t"])
        sets = (texts.join(wanted, ["doc_id", "t"]).select("text", "family", "cuts", "node", "comp")
                .mapInArrow(_members(self.n), "family long, cut long, node long, comp long, tokens binary"))
        key = ["family", "cut"]
        return cut(sets.repartition(partitions(self.spark), *key).sortWithinPartitions(*key, "node").mapInArrow(_join(self.percent), "a long, b long"))

    def components(self, edges: DataFrame) -> DataFrame:
        return components(edges).select("node", F.col("component").alias("comp"))

    def links(self) -> DataFrame:
        """Links (a, b) between nodes that span all components."""
        # First round: the rarest shared token of each set alone, within blocks.
        few = self.places.where("i = 0").select("token", F.col("salt").alias("block"), "node", F.col("node").alias("comp"))
        met = _mixed_groups(few)
        found = self.within(few.join(met, ["token", "block"]), True)
        # One set of each component and block stands for it, until one block holds them all.
        several = self.places.where("i = 0 AND blocks > 1").select("token", "node").limit(1).count() > 0
        while several:
            comp = self.components(found)
            own = few.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            heads = own.groupBy("token", "block", "comp").agg(F.min("node").alias("node")).groupBy("token", "comp").agg(F.min("node").alias("node"))
            size = heads.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            heads = cut(heads.join(size, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / self.block))))
            more = self.within(heads.select("token", "block", "node", "comp"), False)
            fresh = more.limit(1).count() > 0
            several = fresh and heads.where(F.col("m") > self.block).limit(1).count() > 0
            found = cut(found.unionAll(more))
        # Second round: every place and pair of blocks, where sets of different components still meet.
        comp = self.components(found)
        every = cut(self.places.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("i"))
        mixed = every.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        one = every.join(mixed, "token")
        pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                                      lambda o: F.least("salt", o) * F.col("blocks") + F.greatest("salt", o)))
        rows = one.select("token", pairs.alias("block"), "node", "comp")
        rows = rows.join(_mixed_groups(rows), ["token", "block"])
        return found.unionAll(self.within(rows, False))


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """Groups that hold several components."""
    return (rows.groupBy("token", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "block"))


def _classified(docs: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, t (hash of the text), n, class (null for the empty set), component (its least
    class), component_id (its least doc_id) and whether the class is the one of its component that stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    below = front(docs, n, percent)
    heads = store(docs.mapInArrow(_signatures(n, percent, below), "doc_id long, t long, n long, s1 long, s2 long, counted long, head array<long>, sketch binary"), "sets")
    base = store(heads.select("doc_id", "t", "n", "s1", "s2"), "signatures")
    key = ["n", "s1", "s2"]
    nodes = store(heads.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(
        F.min(F.struct("doc_id", "t")).alias("rep"), F.first("counted").alias("counted"), F.first("head").alias("head"), F.first("sketch").alias("sketch"))
        .select(*key, "rep.doc_id", "rep.t", "counted", "head", "sketch", F.monotonically_increasing_id().alias("node")).withColumnRenamed("doc_id", "rep"), "nodes")
    discard(heads)
    join = Join(docs, nodes.drop("head"), nodes.select("node", "head"), n, percent, below, block)
    found = components(join.links())
    named = (nodes.select(*key, "node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    named = named.join(least, "component").select(*key, F.col("least.rep").alias("component_id"), (F.col("node") == F.col("least.node")).alias("stays"))
    return (base.join(named, key, "left")
            .select("doc_id", "t", "n", *key[1:], F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "stays"))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return _classified(docs, n, percent, block).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the first row of ``docs``, by doc_id and then by set and text; of repeated rows
    one stays. Rows without words and rows without a doc_id stay."""
    found = _classified(docs, n, percent).where("doc_id IS NOT NULL")
    blank = found.where("n = 0").select("doc_id", "t")
    first = found.where("stays AND doc_id = component_id").groupBy("doc_id", "s1", "s2").agg(F.min("t").alias("t")).select("doc_id", "t")
    stay = first.unionAll(blank).distinct().select(F.col("doc_id").alias("_stay_id"), F.col("t").alias("_stay_text"))
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own"))
    kept = (rows.join(stay, (F.col("own.id") == F.col("_stay_id")) & (F.col("own.t") == F.col("_stay_text")), "left_semi")
            .dropDuplicates(["own"]).select("row.*"))
    return kept.unionAll(docs.where("doc_id IS NULL"))


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir), 3, 90)
