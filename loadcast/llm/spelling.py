"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter
counts by at most one up in one letter and one down in another.  The words of
a length are cut into cells by a k-d tree whose upper splits are fitted on a
bounded sample; every word lives in one cell and searches the cells whose box
lies within reach, among the words of its own length and of one letter more.
Inside a cell a k-d tree prunes by its nodes' boxes, the counts of what is left are
compared exactly, and the order of the letters decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import ascii_lower, spread, stored, table
from loadcast.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 26 + 64        # a-z and U+00C0 to U+00FF
LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_EVERY = 97
CELL = 65_536            # words of a cell, about; fewer where words are long
CELL_LETTERS = CELL * 64
SAMPLE_WORDS = 50_000    # words that the upper splits are fitted on, about; every word is indexed and searched
LEAF = 64                # words that are compared as they are
BATCH = 8_192            # queries of a cell that are searched at a time
MOST_LEVELS = 64         # bits of counts a word: longer words are compared by counts themselves


def letter_codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    return np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26).astype(np.uint8)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), LETTERS), np.int32)
    np.add.at(out, (np.arange(len(codes))[:, None], codes), 1)
    return out


class Counts:
    """Letter counts of a cell, written so that the letters two words share can be counted at once."""

    def __init__(self, members: np.ndarray):
        self.most = members.max(0)
        self.thermometer = int(members[0].sum()) <= MOST_LEVELS
        # one 0/1 column for every (letter, level) that a member reaches: the shared letters of two words are an inner product
        self.letter = np.repeat(np.arange(LETTERS), self.most)
        self.level = np.concatenate([np.arange(1, m + 1) for m in self.most]) if len(self.letter) else np.zeros(0, int)

    def write(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.letter] >= self.level).astype(np.float32) if self.thermometer else np.minimum(counts, self.most)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that each row of ``a`` shares with each row of ``b``, counted as often as both have them."""
        if self.thermometer:
            return a @ b.T
        return np.stack([np.minimum(a, row).sum(1) for row in b], 1)


class Tree:
    """A k-d tree over the letter counts of words of one length; nodes carry the tight box of what they hold."""

    def __init__(self, counts: np.ndarray):
        self.space = Counts(counts)
        self.order = np.arange(len(counts))
        self.nodes: list[tuple] = []
        todo = [(0, len(counts), None)]
        while todo:
            a, b, parent = todo.pop()
            own = counts[self.order[a:b]]
            lo, hi = own.min(0), own.max(0)
            children: list[int] = []
            self.nodes.append((self.space.write(np.stack([lo, hi])), int(lo.sum()), a, b, children))
            if parent is not None:
                self.nodes[parent][4].append(len(self.nodes) - 1)
            cut = split(own) if b - a > LEAF else None
            if cut is not None:
                left = own[:, cut[0]] <= cut[1]
                rows = self.order[a:b]
                middle = a + int(left.sum())
                self.order[a:b] = np.concatenate([rows[left], rows[~left]])
                here = len(self.nodes) - 1
                todo += [(a, middle, here), (middle, b, here)]

    def within(self, written: np.ndarray, length: int, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) of every leaf whose box a query reaches with at
        most ``up`` letters more and ``down`` letters less."""
        todo = [(0, np.arange(len(written)))]
        while todo:
            k, q = todo.pop()
            box, low, a, b, children = self.nodes[k]
            s = self.space.shared(written[q], box)
            q = q[(low - s[:, 0] <= up) & (length - s[:, 1] <= down)]
            if len(q) and children:
                todo += [(c, q) for c in children]
            elif len(q):
                yield q, self.order[a:b]


def split(own: np.ndarray) -> tuple[int, int] | None:
    """(letter, count): words of at most that count go left; the letter whose counts vary most, at the middle. None: all alike."""
    d = int(own.astype(np.float32).var(0).argmax())
    values, n = np.unique(own[:, d], return_counts=True)
    if len(values) < 2:
        return None
    below = np.cumsum(n)[:-1]
    return d, int(values[np.abs(below - len(own) / 2).argmin()])


def upper_tree(counts: np.ndarray, leaf: float) -> list:
    """Splits over a sample: nested [letter, count, left, right], or a cell's number."""
    cells = 0

    def build(own: np.ndarray) -> list | int:
        nonlocal cells
        cut = split(own) if len(own) > leaf else None
        if cut is None:
            cells += 1
            return cells - 1
        left = own[:, cut[0]] <= cut[1]
        return [*cut, build(own[left]), build(own[~left])]

    return [build(counts)]


def visits(tree: list, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells whose box a row reaches with at most ``up``
    letters more and ``down`` less; with 0 and 0 the one cell that holds it."""
    zero = np.zeros(len(counts), np.int32)
    todo = [(tree[0], np.arange(len(counts)), zero, zero, {}, {})]
    rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
    while todo:
        node, q, more, less, low, high = todo.pop()
        if not len(q):
            continue
        if isinstance(node, int):
            rows.append(q)
            cells.append(np.full(len(q), node))
            continue
        d, t, left, right = node
        own = counts[q, d]
        # the box shrinks in this letter alone: what the letter lacks or has too much replaces what it did before
        fall = less + np.maximum(own - t, 0) - (np.maximum(own - high[d], 0) if d in high else 0)
        rise = more + np.maximum(t + 1 - own, 0) - (np.maximum(low[d] - own, 0) if d in low else 0)
        ok = fall <= down
        todo.append((left, q[ok], more[ok], fall[ok], low, {**high, d: t}))
        ok = rise <= up
        todo.append((right, q[ok], rise[ok], less[ok], {**low, d: t + 1}, high))
    return np.concatenate(rows), np.concatenate(cells)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    long = np.array([len(w) for w in words])
    for length in np.unique(long):
        at = np.flatnonzero(long == length)
        yield int(length), at, [words[i] for i in at]


def _route(trees: dict[int, list]):
    """Words to (length, cell, query, word, n): a word's own cell (query 0), and the cells it
    searches for words of its length (1) and of one letter more (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, at, own in by_length(words):
                counts = letter_counts(letter_codes(own, length))
                for query, (target, up, down) in enumerate([(length, 0, 0), (length, 1, 1), (length + 1, 1, 0)]):
                    rows, cells = visits(trees.get(target, [0]), counts, up, down)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), target, np.int32)), pa.array(cells.astype(np.int32)), pa.array(np.full(len(rows), query, np.int32)),
                         batch.column("word").take(pa.array(at[rows])), pa.array(n[at[rows]])],
                        ["length", "cell", "query", "word", "n"],
                    )

    return run


def one_apart(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For rows of letters: whether a row of ``t`` is the row of ``q`` with one
    letter replaced (equal widths) or inserted (``t`` one wider)."""
    width = q.shape[1]
    if t.shape[1] == width:
        return (q != t).sum(1) == 1
    head, tail = q == t[:, :-1], q == t[:, 1:]
    before = np.where(head.all(1), width, head.argmin(1))
    after = np.where(tail.all(1), width, tail[:, ::-1].argmin(1))
    return before + after >= width


class Cell:
    """The words of one cell and the tree over them."""

    def __init__(self, words: list[str], n: list[int], length: int):
        order = sorted(range(len(words)), key=words.__getitem__)  # places stand in code-point order: ties go to the smaller place
        self.words, self.n, self.length = [words[i] for i in order], np.array([n[i] for i in order]), length
        self.codes = letter_codes(self.words, length)
        counts = letter_counts(self.codes)
        self.tree = Tree(counts)
        self.written = self.tree.space.write(counts)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all pairs one edit apart."""
        longer = codes.shape[1] < self.length
        written = self.tree.space.write(letter_counts(codes))
        goal = codes.shape[1] - (not longer)  # letters that a pair one edit apart shares
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for q, m in self.tree.within(written, codes.shape[1], 1, int(not longer)):
            i, j = np.nonzero(self.tree.space.shared(written[q], self.written[m]) == goal)
            ok = one_apart(codes[q[i]], self.codes[m[j]])
            found.append((q[i[ok]], m[j[ok]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_of(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per value of ``a``: how many pairs, and the partner of largest n, then smallest place."""
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return a[first], np.diff(np.append(first, len(a))), b[first]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, cell, block, query) to (word, n_near, best_n, best): a summary a word and
    batch.  Memory holds a cell's words and one batch of queries."""
    key, words, counts, cell = None, [], [], None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy() for c in ("length", "cell", "block", "query", "n")}
        text = batch.column("word").to_pylist()
        keys = np.stack([cols["length"], cols["cell"], cols["block"]], 1)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1) | (cols["query"][1:] != cols["query"][:-1])]) if len(text) else []
        for s, e in zip(cuts, np.append(cuts[1:], len(text)).astype(int) if len(text) else [], strict=True):
            if key != tuple(keys[s]):
                key, words, counts, cell = tuple(keys[s]), [], [], None
            if cols["query"][s] == 0:
                words += text[s:e]
                counts += cols["n"][s:e].tolist()
                continue
            if not words:
                continue  # nobody lives where these would look
            cell = cell or Cell(words, counts, int(key[0]))
            for lo in range(s, e, BATCH):
                at = sorted(range(lo, min(e, lo + BATCH)), key=text.__getitem__)
                asked, n = [text[i] for i in at], cols["n"][at]
                q, m = cell.near(letter_codes(asked, len(asked[0])))
                if not len(q):
                    continue
                out = [(asked, cell.words, cell.n, *best_of(q, m, cell.n))]
                if cols["query"][s] == 2:  # words of one letter more do not search back
                    out.append((cell.words, asked, n, *best_of(m, q, n)))
                for own, other, many, a, near, b in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own[i] for i in a], pa.string()), pa.array(near.astype(np.int64)), pa.array(many[b].astype(np.int64)), pa.array([other[i] for i in b], pa.string())],
                        ["word", "n_near", "best_n", "best"],
                    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word (letters only, distinct; with its n) that has
    a near word; ``best`` is the near word of largest n, then smallest by code point."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")))
    total = words.count()
    picked = words.where(spread("word", seed=13) * total <= SAMPLE_WORDS) if total > SAMPLE_WORDS else words
    trees = {}
    sample = [r.word for r in picked.select("word").collect()]
    for length, _, own in by_length(sample):
        most = min(CELL, max(1, CELL_LETTERS // length))
        trees[length] = upper_tree(letter_counts(letter_codes(own, length)), most * len(sample) / total)
    routed = stored(words.mapInArrow(_route(trees), "length int, cell int, query int, word string, n long"))
    # a cell that the sample did not foresee, or of words with equal counts, is dealt into blocks; its queries visit each
    most = F.least(F.lit(2 * CELL), F.greatest(F.lit(1), F.floor(F.lit(2 * CELL_LETTERS) / F.col("length"))))
    sizes = routed.where("query = 0").groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    blocks = F.when(F.col("query") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = routed.join(sizes, ["length", "cell"]).withColumn("block", F.explode(blocks))
    found = (
        dealt.select("length", "cell", "block", "query", "word", "n")
        .repartition("length", "cell", "block").sortWithinPartitions("length", "cell", "block", "query")
        .mapInArrow(_search, "word string, n_near long, best_n long, best string")
    )
    top = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of every word with a form, by pointer doubling; n at
    least doubles from a word to its form, so chains are short and end."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(steps.join(ahead, "root", "left"))
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if not joined.where("next IS NOT NULL").limit(1).count():
            return steps


def group_spellings(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words and their counts (word string, n long).

    ``form`` is the near word of largest n (ties: smallest by code point) if
    that n is at least twice the word's; ``root`` follows forms to the end.
    Words are distinct and of lower-case letters (a-z, U+00C0 to U+00FF); an
    empty frame gives an empty one.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")))
    near = cut_lineage(near_words(words))
    takes = F.col("best_n") >= 2 * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    )
    known = cut_lineage(known)
    return known.join(roots(known.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n",
    )


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, with one letter deleted where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    without = F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(DROP_EVERY)) == 0, without).otherwise(run)


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least five letters that occur at least three
    times over all documents.  A null text has no words, a null id counts as
    empty; a repeated row counts again; words of any length count."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH).select("id", ascii_lower("run").alias("run"))
    words = runs.select(misspelt(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def op13_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return group_spellings(count_words(table(spark, root, "documents", "doc_id", "text")))


def op13_sql() -> str:
    """The same by deletions: words one edit apart share what is left without one letter.  The checksum is written out byte by byte."""
    return r"""
    WITH RECURSIVE bits(i, c, k) AS (
        SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
    ), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    runs AS MATERIALIZED (
        SELECT doc_id, run, count(*) AS m FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
        WHERE length(run) >= 5 GROUP BY 1, 2
    ), hashed AS (
        SELECT run, m, xor(list_reduce(
            list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [195::UBIGINT, (ord(x) - 64)::UBIGINT] END))),
            lambda a, b: xor(a >> 8, t[(xor(a, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) AS h
        FROM runs, crc
    ), words AS MATERIALIZED (
        SELECT word, sum(m)::BIGINT AS n FROM (
            SELECT m, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3
    ), less AS MATERIALIZED (
        SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM words, range((SELECT max(length(word)) FROM words)) t(i) WHERE i < length(word)
    ), pairs AS (
        SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word
    ), near AS (SELECT word, count(*) AS n_near, max(m) AS best_n FROM pairs GROUP BY word),
    best AS (SELECT word, min(other) AS best FROM pairs JOIN near USING (word) WHERE m = best_n GROUP BY word),
    forms AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
        FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)
    ), chain(word, far) AS (
        SELECT word, word FROM forms
        UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.far = f.word WHERE f.form IS NOT NULL
    ), root AS (SELECT c.word, c.far AS root FROM chain c JOIN forms f ON c.far = f.word WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN root USING (word)
    """
