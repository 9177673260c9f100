"""Spelling variants: words that one inserted, deleted or replaced letter apart, by a trie over letter-group counts.

Words are counted per task and added up by Spark.  Each word has a vector, how often it has letters of each of
GROUPS; the words, sorted by vector, form a trie whose levels are the counts.  One edit adds at most one letter to
one group (a surplus) and takes at most one from another (a deficit), so a depth-first search that may spend one
of each reaches the leaves of all near words.  A leaf's words are looked up by equal halves (one edit leaves the
first or the last half of the shorter word as it is) and then compared letter by letter.

The trie is cut where a subtree holds few enough words.  Each word is a member of its own subtree and a query to
those that its budget can reach, so a subtree is one group of rows, the work follows the number of words, and no
task holds more than a subtree's members and a block of queries.  Every pair is looked for from one side: the
shorter word, or the one with fewer letters in the first group that differs.

Odd rows: a null text has no words; a null doc_id counts as an empty one in the hash; rows that repeat a doc_id
count each.  No documents, or no word twice: no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.blocks import U64

#: Letters of each level of the trie; all others (k, q, x, z, accents and so on) are one more group.
GROUPS = ("e", "a", "i", "o", "n", "r", "t", "s", "l", "u", "d", "c", "m", "pb", "gh", "fvw")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LONGEST = 48  # longer words are compared one by one
KEEP_WORDS, QUERY_BLOCK, STATES, LEAF = 400_000, 100_000, 1 << 17, len(GROUPS) + 1


def counted_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): maximal runs of letters with A-Z lowered, one letter gone where the run's hash says so.

    The hash is the crc32 of ``<doc_id>:<run>``; where ``every`` divides it, letter hash % length goes.  Results
    under ``least`` letters are left out.
    """
    run_of = re.compile(rf"(?<![a-zÀ-ÿ])[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for part, raw in blocks.chunks(batches):
            for doc, text in zip(part.column(0).to_pylist(), raw, strict=True):
                seed, crc = zlib.crc32(f"{doc}:".encode()), zlib.crc32
                for word, n in Counter(run_of.findall(text.translate(LOWER).decode())).items():
                    h = crc(word.encode(), seed)
                    if not h % every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
            if len(total) > KEEP_WORDS:
                yield _rows(total)
                total = Counter()
        yield _rows(total)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rows(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def _groups() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)
    for i, letters in enumerate(GROUPS):
        out[list(letters.encode())] = i
    return out


class Spelt:
    """Words (Latin-1 bytes) as flat letters with their vectors and hashes of their halves."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(words)), self.size)
        self.vector = np.bincount(owner * LEAF + _groups()[self.flat], minlength=len(words) * LEAF).reshape(len(words), LEAF)

    def halves(self, shorter: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last half, as a partner that has ``shorter`` letters less would be cut."""
        up, down = blocks._powers(len(self.flat) + 1)
        total = np.zeros(len(self.flat) + 1, U64)
        np.cumsum((self.flat.astype(U64) + U64(1)) * up[: len(self.flat)], dtype=U64, out=total[1:])
        end, least = self.start + self.size, self.size - shorter
        first, last = self.start + least // 2, end - (least - least // 2)
        return (total[first] - total[self.start]) * down[self.start], (total[end] - total[last]) * down[last]

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """The letters of words up to LONGEST, set to the left and to the right of rows."""
        left, right = (np.zeros((len(self.words), LONGEST), np.uint8) for _ in range(2))
        some = self.size <= LONGEST
        owner = np.repeat(np.arange(len(self.words)), self.size)
        keep = some[owner]
        at = (np.arange(len(self.flat)) - self.start[owner])[keep]
        left[owner[keep], at] = self.flat[keep]
        right[owner[keep], LONGEST - self.size[owner[keep]] + at] = self.flat[keep]
        return left, right


def _child(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    return blocks.mix(node * U64(blocks.BASE) + count.astype(U64) + U64(1))


def _paths(vector: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of the nodes on each word's way from the root to its leaf."""
    node = np.zeros(len(vector), U64)
    yield node
    for level in range(LEAF):
        node = _child(node, vector[:, level])
        yield node


def crowded(words: DataFrame, most: int, step: int = 5) -> np.ndarray:
    """Sorted ids of the nodes with more than ``most`` words below them: at most levels x words / most of them.

    Some levels at a time: only words below a crowded node are counted on the next ones.
    """
    hot, last = np.empty(0, U64), np.zeros(1, U64)
    for top in range(0, LEAF + 1, step):

        def run(batches: Iterator[pa.RecordBatch], top: int = top, last: np.ndarray = last) -> Iterator[pa.RecordBatch]:
            ids, n = np.empty(0, U64), np.empty(0, np.int64)
            for batch in batches:
                ways = list(_paths(Spelt([w.encode("latin-1") for w in batch.column(0).to_pylist()]).vector))
                below = np.isin(ways[max(top - 1, 0)], last)
                got, m = blocks.tally(np.concatenate([w[below] for w in ways[top : top + step]]))
                ids, n = blocks.tally(np.concatenate([ids, got]), np.concatenate([n, m]))
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], ["node", "n"])

        rows = words.select("word").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
        last = np.array([r.node for r in rows.filter(F.col("n") > most).select("node").collect()], np.int64).view(U64)
        hot = np.union1d(hot, last)
        if not len(last):
            break
    return hot


#: kind: 0 a member, 1 a query; half: 0 looked up by both halves, 1 by the first, 2 by the last one (crowded leaves).
ROUTED = "node long, kind int, half int, word string, n long"


def _routes(spelt: Spelt, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(node, word, kind, half): the subtrees in which words are members, and those that queries can reach."""
    everyone = np.arange(len(spelt.words))
    for kind in (0, 1):
        node, who, spent = np.zeros(len(everyone), U64), everyone, np.zeros(len(everyone), np.int8)
        for level in range(LEAF + 1):
            deeper = np.isin(node, hot)
            yield node[~deeper], who[~deeper], kind, 0
            node, who, spent = node[deeper], who[deeper], spent[deeper]
            if not len(node):
                break
            if level == LEAF:
                yield from _by_halves(spelt, node, who, kind)
                break
            q = spelt.vector[who, level]
            ways = [(_child(node, q), who, spent)]
            if kind:
                for some, change, after in ((spent == 0, 1, 1), ((spent == 1) & (q > 0), -1, 2)):
                    ways.append((_child(node[some], q[some] + change), who[some], np.full(some.sum(), after, np.int8)))
            node, who, spent = (np.concatenate(x) for x in zip(*ways, strict=True))


def _by_halves(spelt: Spelt, node: np.ndarray, who: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The words of a crowded leaf are dealt by their halves; a member also by those that a shorter partner has."""
    for half in (1, 2):
        place = [blocks.mix(node ^ (spelt.halves(shorter)[half - 1][who] % U64(1 << 20) * U64(2) + U64(half - 1))) for shorter in (0, 1)]
        yield place[0], who, kind, half
        if not kind:
            other = place[0] != place[1]
            yield place[1][other], who[other], kind, half


def routed(words: DataFrame, hot: np.ndarray) -> DataFrame:
    """Each word as a member of its subtree and as a query to the subtrees that one edit can lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                spelt = Spelt([w.encode("latin-1") for w in part.column(0).to_pylist()])
                for node, who, kind, half in _routes(spelt, hot):
                    if len(who):
                        at, fixed = pa.array(who), (pa.array(np.full(len(who), x, np.int32)) for x in (kind, half))
                        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *fixed, part.column(0).take(at), part.column(1).take(at)], [x.split()[0] for x in ROUTED.split(", ")])

    return words.select("word", "n").mapInArrow(run, ROUTED)


class Subtree:
    """The members of a subtree as a trie of counts, with look-ups by halves at its leaves."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        made = Spelt(words)
        order = np.lexsort((np.arange(len(words)), *made.vector.T[::-1]))
        self.spelt, self.n = Spelt([words[i] for i in order.tolist()]), n[order]
        vector, self.levels = self.spelt.vector, []
        self.widest = int(vector.max(initial=0)) + 1
        parent, new = np.zeros(len(words), np.int64), np.r_[True, np.zeros(len(words) - 1, bool)]
        for level in range(LEAF):
            new = new | np.r_[True, vector[1:, level] != vector[:-1, level]]
            self.levels.append((parent * self.widest + vector[:, level])[new])
            parent = np.cumsum(new) - 1
        self.tables = {}
        for shorter in (0, 1):
            for half, h in enumerate(self.spelt.halves(shorter)):
                key = self.key(parent, h)
                by = np.argsort(key, kind="stable")
                self.tables[shorter, half] = key[by], by
        self.left, self.right = self.spelt.squares()

    @staticmethod
    def key(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
        return blocks.mix(blocks.mix(half) + leaf.astype(U64) * U64(blocks.BASE))

    def leaves(self, vector: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, spent) by depth-first search over blocks of states; spent: 0 nothing, 1 a surplus, 2 a deficit as well."""
        zero = np.zeros(len(vector), np.int64)
        stack = [(0, np.arange(len(vector)), zero, zero.astype(np.int8))]
        while stack:
            level, who, node, spent = stack.pop()
            if len(who) > STATES:
                stack += [(level, who[a : a + STATES], node[a : a + STATES], spent[a : a + STATES]) for a in range(0, len(who), STATES)]
                continue
            if level == LEAF:
                yield who, node, spent
                continue
            keys, q, found = self.levels[level], vector[who, level], []
            for change, some, more in ((0, slice(None), 0), (1, spent == 0, 1), (-1, spent == 1, 1)):
                w, p, c, s = who[some], node[some], q[some] + change, spent[some] + np.int8(more)
                fits = (c >= 0) & (c < self.widest)
                want = p * self.widest + c
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = fits & (keys[at] == want)
                found.append((w[hit], at[hit], s[hit]))
            who, node, spent = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(who):
                stack.append((level + 1, who, node, spent))

    def near(self, queries: Spelt, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all near words to which the query is the searching side."""
        own, pairs = queries.halves(0), []
        for who, leaf, spent in self.leaves(queries.vector):
            for state in (0, 1, 2):
                some = spent == state
                for side in (0, 1):
                    if half in (0, side + 1) and some.any():
                        pairs += self._verified(queries, who[some], leaf[some], own[side], state, side)
        q, m = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
        return q, m

    def _verified(self, queries: Spelt, who: np.ndarray, leaf: np.ndarray, halves: np.ndarray, state: int, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within leaves with an equal half; words of equal vectors meet from both sides, the lesser one counts."""
        longer = int(state == 1)
        keys, by = self.tables[longer, side]
        want = self.key(leaf, halves[who])
        a = np.searchsorted(keys, want)
        n = np.searchsorted(keys, want, "right") - a
        q = np.repeat(who, n)
        m = by[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for x in range(0, len(q), STATES):
            i, j = q[x : x + STATES], m[x : x + STATES]
            some = self.spelt.size[j] == queries.size[i] + longer
            if not state:
                some &= np.fromiter((queries.words[p] < self.spelt.words[r] for p, r in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            yield self._one_edit(queries, i[some], j[some], longer, side)

    def _one_edit(self, queries: Spelt, i: np.ndarray, j: np.ndarray, longer: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that one edit parts; those with equal first halves count on side 0 alone."""
        ok = np.zeros(len(i), bool)
        short = (queries.size[i] <= LONGEST) & (self.spelt.size[j] <= LONGEST)
        first, last = self._same(queries, i[short], j[short])
        least = queries.size[i[short]]
        good = first + last >= least - (1 - longer)
        ok[short] = good & ((first < least // 2) if side else True)
        for k in np.flatnonzero(~short).tolist():
            a, b = queries.words[i[k]], self.spelt.words[j[k]]
            first = _common(a, b)
            last = _common(a[::-1], b[::-1])
            ok[k] = first + last >= len(a) - (1 - longer) and not (side and first >= len(a) // 2)
        return i[ok], j[ok]

    def _same(self, queries: Spelt, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common beginnings and endings."""
        if queries not in (got := self.__dict__.setdefault("_squares", {})):
            got.clear()
            got[queries] = queries.squares()
        left, right = got[queries]
        d, e = left[i] != self.left[j], (right[i] != self.right[j])[:, ::-1]
        least = queries.size[i]
        first = np.where(d.any(1), d.argmax(1), LONGEST)
        last = np.where(e.any(1), e.argmax(1), LONGEST)
        return np.minimum(first, least), np.minimum(last, least)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    d = np.flatnonzero(x != y)
    return int(d[0]) if len(d) else n


NEAR = "word string, n_near long, less long, form string"


def _best(of: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each that occurs in ``of``: it, how often, and the place of its pair with the largest n (least rank of equals)."""
    order = np.lexsort((rank, -n, of))
    first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else np.empty(0, np.int64)
    return of[order[first]], np.diff(np.r_[first, len(of)]), order[first]


def near_words(dealt: DataFrame) -> DataFrame:
    """(word, n_near, less, form) for each word with near ones: how many, and the one with the largest n (-less).

    A task's rows come sorted by subtree, members first, so it holds one subtree's members and a block of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half, members, queries in _by_node(batches):
            tree = members if isinstance(members, Subtree) else Subtree(*members)
            own = Spelt(queries[0])
            q, m = tree.near(own, half)
            both = own.words, tree.spelt.words
            ranks = [np.argsort(np.argsort(np.array(w, object), kind="stable"), kind="stable") for w in both]
            cols = []
            for of, other, names, others, n, rank in ((q, m, both[0], both[1], tree.n, ranks[1]), (m, q, both[1], both[0], queries[1], ranks[0])):
                who, count, place = _best(of, n[other], rank[other])
                best = other[place]
                cols.append(([names[x].decode("latin-1") for x in who.tolist()], count, -n[best], [others[x].decode("latin-1") for x in best.tolist()]))
            for words, count, less, form in cols:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(count, pa.int64()), pa.array(less, pa.int64()), pa.array(form, pa.string())], [x.split()[0] for x in NEAR.split(", ")])

    n = blocks.shards(dealt.sparkSession)
    found = dealt.repartition(n, "node").sortWithinPartitions("node", "half", "kind").mapInArrow(run, NEAR)
    best = F.min(F.struct("less", "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", "_b.less", "_b.form")


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, tuple[list[bytes], np.ndarray]]]:
    """(half, members, queries) of each subtree with both, its queries in blocks; the second block has the built trie."""
    now, members, queries = None, ([], []), ([], [])

    def block() -> Iterator[tuple]:
        nonlocal members, queries
        if queries[0] and (isinstance(members, Subtree) or members[0]):
            if not isinstance(members, Subtree):
                members = Subtree(members[0], np.array(members[1], np.int64))
            yield now[1], members, (queries[0], np.array(queries[1], np.int64))
        queries = ([], [])

    for batch in batches:
        node, kind, half = (batch.column(k).to_numpy() for k in (0, 1, 2))
        words, n = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (half[1:] != half[:-1]) | (kind[1:] != kind[:-1])) + 1 if len(node) else []
        ends = [0, *map(int, cuts), len(node)]
        for a, b in zip(ends, ends[1:], strict=False):
            if a == b:
                continue
            if (node[a], half[a]) != now:
                yield from block()
                now, members = (node[a], half[a]), ([], [])
            into = queries if kind[a] else members
            into[0].extend(w.encode("latin-1") for w in words[a:b])
            into[1].extend(n[a:b])
            if len(queries[0]) >= QUERY_BLOCK:
                yield from block()
    yield from block()


def variants(docs: DataFrame, least_n: int = 2, times: int = 10, subtree: int = 10_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words that occur ``least_n`` times; see the module.

    form is the near word with the largest n (the first in code-point order of equals) if that is ``times`` the
    word's own; root is what following forms leads to.  ``subtree`` is the number of words from which a subtree is
    cut further; it grows with the words, so that the list of crowded nodes stays bounded.
    """
    spark = docs.sparkSession
    folder = blocks.shared_dir(spark, "spelling")
    with blocks.shuffles_dropped(spark):
        words = blocks.written(counted_words(docs).filter(F.col("n") >= least_n), f"{folder}/words")
        total, top = words.agg(F.count("*"), F.max("n")).first()
        most = max(subtree, total // 5_000)
        dealt = routed(words, crowded(words, most))
        near = blocks.written(near_words(dealt), f"{folder}/near")
        own = words.join(near.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
        strong = -F.col("less") >= F.col("n") * times
        form = own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, -F.col("less")).cast("long").alias("form_n"))
        form = blocks.written(form, f"{folder}/forms")
        roots = _roots(form.filter("form is not null").select("word", F.col("form").alias("root")), int(top or 1), times, folder)
    out = form.join(roots.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, top: int, times: int, folder: str) -> DataFrame:
    """(word, root) by pointer doubling; each step multiplies n, so chains are short and the rounds known."""
    longest = 1 + int(math.log(max(top, 1)) / math.log(times))
    roots = forms
    for turn in range(max(longest - 1, 0).bit_length()):
        far = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = blocks.written(roots.join(far, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), f"{folder}/roots-{turn}")
    return roots
