"""SimHash groups, line dedup, substring dedup and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sealtable.llm import common, near_copies, simhash, substring
from sealtable.llm.components import connected_components
from sealtable.llm.line_dedup import dedup_lines, kept_runs
from sealtable.llm.simhash import keep_one, near_components, near_links, simhash64
from sealtable.llm.substring import chains, passage_links, passages, repeated_passages, seed_pairs, seeds, word_hashes

SCHEMA = "doc_id long, text string, score double, digest string, root int"
VOCABULARY = [f"w{i}" for i in range(4000)]


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("local_edges", [500_000, 15])
@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape, local_edges):
    """Also where no task holds the whole graph."""
    rng = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(50) if i != 7] + [(100, 101), (5, 5), (101, 100)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [],
    }[shape]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges)
    expected = roots([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["root"] for r in found.collect()} == expected


def slow_simhash(text, n=3):
    tokens = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [None, "", " \n", "One", "one two", "A b  C\td", "É x É x É x", "\u00a0 a\u00a0b c d", words(random.Random(1), 300)]:
        assert simhash64(text) == slow_simhash(text)


@pytest.mark.parametrize("light", [64, 2])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_near_links(spark, light, bits):
    """Also where keys are crowded: with light=2 nearly all links come from the bounded groups."""
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3]))) for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, light).collect()
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits]
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= bits for r in got)
    assert roots((r["a"], r["b"]) for r in got) == roots(near)


def test_simhash_groups(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, None), (201, ""), (202, " \n"), (None, rows[5][1]), (None, None), (7, rows[7][1]), (7, words(rng, 30))]
    got = near_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [(d, slow_simhash(t)) for d, t in rows]
    edges = [(a, b) for _, a in prints for _, b in prints if a < b and bin(a ^ b).count("1") <= 2]
    of = roots(edges)
    least = defaultdict(list)
    for d, p in prints:
        least[of.get(p, p)].append(d)
    expected = sorted((str(d), p, str(min((x for x in least[of.get(p, p)] if x is not None), default=None))) for d, p in prints)
    assert sorted((str(r["doc"]), r["fp"] % (1 << 64), str(r["component"])) for r in got) == expected


def test_keep_one(spark):
    rng = random.Random(9)
    base = words(rng, 40)
    rows = [(5, base), (3, base), (3, base), (9, base.upper()), (1, words(rng, 40)), (1, words(rng, 40)), (None, words(rng, 30)), (None, words(rng, 30)), (20, None), (21, "")]
    kept = keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "digest", "root"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "20", "3", "None", "None"]
    assert keep_one(frame(spark, []).limit(0)).count() == 0


def test_pipeline_drops_edited_copies(spark):
    """The near-dedup stage against brute force at a shingle similarity of 0.8, with one- and few-word edits."""
    rng = random.Random(31)
    rows = []
    for case in range(60):
        base = words(rng, rng.choice([50, 100, 200, 500])).split()
        rows.append((10 * case, " ".join(base)))
        for k in range(1, 4):
            edited = list(base)
            for at in rng.sample(range(len(base)), k):
                edited[at] = "edited"
            rows.append((10 * case + k, " ".join(edited)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] // 10 == rows[j][0] // 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    of = roots(near)
    wanted = sorted({rows[of.get(i, i)][0] for i in range(len(rows))})
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    assert got == wanted and len(wanted) < 100


@pytest.mark.parametrize("tile", [16, 512])
def test_crowded_bands(spark, monkeypatch, tile):
    """Texts whose only similar one is no neighbour in a crowded band are found, be they in one tile or several."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(51)
    texts = [(i, words(rng, 60)) for i in range(200)]
    partners = [(200 + i, t + " end") for i, (_, t) in enumerate(texts[:40])]
    docs = spark.createDataFrame(texts + partners, "doc_id long, text string")
    prints = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("digest"))
    signed = prints.selectExpr("7L as h", "0L as after", "0L as before", "digest as text", "0 as spot")
    rooted = prints.select("digest", F.col("digest").alias("root"))
    doc_of = {r["digest"]: r["doc"] for r in prints.collect()}
    got = near_copies.crowd_links(docs, prints, signed, rooted, 0.8).collect()
    assert {tuple(sorted((doc_of[r["a"]], doc_of[r["b"]]))) for r in got} == {(i, 200 + i) for i in range(40)}
    # Of one component: nothing to compare.
    assert near_copies.crowd_links(docs, prints, signed, rooted.withColumn("root", F.lit(1)), 0.8).count() == 0


def test_pipeline_loses_no_link_in_crowded_bands(spark, monkeypatch):
    """Near copies that all share a band, of which neighbours are made useless, still leave one document each."""
    monkeypatch.setattr(near_copies, "bands", lambda shingles: np.arange(1, near_copies.BANDS + 1, dtype=np.int64))
    rng = random.Random(52)
    texts = [words(rng, 50) for _ in range(60)]
    rows = list(enumerate(texts + [f"{t} end" for t in texts]))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    assert got == list(range(60))


def slow_lines(rows, least=20, most=3):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < most or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = ["A license line that all documents carry", "  a LICENSE line that all documents carry\t", "short", "", "É" * 20, "é" * 20, "exactly twenty chars", "nineteen characters", *(words(rng, 8) for _ in range(30))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, pool[0]), (904, "\n".join([pool[0]] * 3)), (905, "\n".join(rng.choice(pool) for _ in range(3000)))]
    got = dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == slow_lines(rows)
    twice = rows[:40] + rows[:10]
    got = dedup_lines(frame(spark, twice)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == slow_lines(twice)
    assert kept_runs(frame(spark, []).limit(0)).count() == 0
    assert dedup_lines(frame(spark, [(1, "x")])).columns == ["doc_id", "text", "score", "digest", "root", "n_lines", "n_dropped"]


def test_line_runs_are_compressed(spark):
    """Runs of kept lines: none at all, or what stands before, between and after the dropped ones."""
    again = ["the very same long line here"] * 50
    rows = [(i, "\n".join(again)) for i in range(4)] + [(-1, "\n".join(["a", "b", *again, "c", *again, "d"]))]
    runs = kept_runs(frame(spark, rows)).select("doc", "runs").collect()
    assert {r["doc"]: [tuple(x) for x in r["runs"]] for r in runs} == {i: [] for i in range(3)} | {-1: [(0, 2), (52, 1), (103, 1)]}


def slow_chain_score(a, b):
    points = sorted(zip(a, b), key=lambda p: (p[0], -p[1]))
    best = []
    for i, (x, y) in enumerate(points):
        before = [best[j] - substring.GAP_COST * (x - u + y - v) for j, (u, v) in enumerate(points[:i]) if u < x and v < y]
        best.append(substring.KMER + max([0.0, *before]))
    return max(best)


def test_chains():
    rng = np.random.RandomState(2)
    for n in (1, 2, 10, 60):
        a, b = rng.randint(0, 200, n), rng.randint(0, 200, n)
        found = chains(a, b)
        assert sorted(p for c in found for p in c) == sorted(zip(a.tolist(), b.tolist()))
        for chain in found:
            assert all(u < x and v < y for (u, v), (x, y) in zip(chain, chain[1:]))
        steps = zip(found[0], found[0][1:])
        score = substring.KMER * len(found[0]) - sum(substring.GAP_COST * (x - u + y - v) for (u, v), (x, y) in steps)
        assert score == pytest.approx(slow_chain_score(a, b))


def test_seeds_cover_shared_runs():
    rng = random.Random(6)
    run = words(rng, substring.WINDOW + substring.KMER - 1)
    for _ in range(50):
        one, two = (set(seeds(word_hashes(f"{words(rng, rng.randrange(40))} {run} {words(rng, rng.randrange(40))}"))[0].tolist()) for _ in range(2))
        assert one & two


def test_seed_pairs_cross_partitions(spark):
    """A seed of many texts, spread over many ranges, still links all of them in a row."""
    rng = random.Random(7)
    run = words(rng, 60)
    texts = [(i, f"{words(rng, 20)} {run} {words(rng, 20)}") for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        pairs = seed_pairs(spark.createDataFrame(texts, "digest long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(roots((r["a"], r["b"]) for r in pairs).values()) == {0}
    assert len(pairs) <= 130 * 60


def test_passages(spark):
    rng = random.Random(10)
    exact, fuzzy = words(rng, 55), words(rng, 90).split()
    changed = [w for i, w in enumerate(fuzzy) if i % 20 != 7]
    changed[30] = "other"
    rows = [(i, words(rng, 120)) for i in range(20)]
    rows += [(100 + i, f"{words(rng, 30 + i)} {exact} {words(rng, 80)}") for i in range(6)]
    rows += [(200, f"{words(rng, 70)} {' '.join(fuzzy)} {words(rng, 20)}"), (201, f"{' '.join(changed)} {words(rng, 60)}")]
    rows += [(300, rows[0][1]), (301, rows[0][1].upper()), (400, "too short"), (401, "too short"), (500, None), (501, ""), (502, words(rng, 30) + " " + words(rng, 49))]
    rows += [(503, rows[-1][1].split(" ", 30)[-1])]
    got = {r["doc"]: r for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {0, 300, 301, 200, 201, *range(100, 106)}
    assert {got[i]["class_id"] for i in range(100, 106)} == {100} and got[201]["class_id"] == 200 and got[301]["class_id"] == 0
    for i in range(100, 106):
        assert [tuple(s) for s in got[i]["spans"]] == [(30 + i - 100, 85 + i - 100)]
    assert abs(got[200]["n_repeated"] - 90) <= 2 and got[300]["n_repeated"] == 120 and got[300]["n_copies"] == 2
    keyed, links = passage_links(frame(spark, rows))
    assert keyed.count() == len(rows) and links.filter("similarity < 0.8").count() == 0
    assert repeated_passages(frame(spark, []).limit(0)).count() == 0


def test_passages_are_cut_back():
    """Surroundings that agree loosely don't drag an exact passage below the least similarity."""
    rng = random.Random(12)
    exact = [rng.randrange(1 << 31) for _ in range(50)]
    sides = []
    for _ in range(2):
        around = [rng.randrange(1 << 31) for _ in range(2 * 18)]
        sides.append(around[:18] + exact + around[18:])
    for at in (2, 8, 14, 72, 78, 84):
        sides[0][at : at + 2] = sides[1][at : at + 2] = [at, at + 1]
    (found,) = passages(*sides, 0, 0, [(18 + i, 18 + i) for i in (0, 20, 45)])
    assert found[0] <= 18 and found[1] >= 68 and found[4] >= 0.8 * (found[1] - found[0])
    # Ten other words in the middle of a hundred don't part it.
    one, two = ([rng.randrange(1 << 31) for _ in range(10)] for _ in range(2))
    left, right = exact[:45], [rng.randrange(1 << 31) for _ in range(45)]
    assert passages(left + one + right, left + two + right, 0, 0, [(5, 5), (70, 70)]) == [(0, 100, 0, 100, 90)]


def test_passage_of_frequent_lines(spark):
    """Two texts share a passage whose every line many others hold, each among words of its own."""
    rng = random.Random(21)
    rows, wanted = [], set()
    for case in range(8):
        lines = [words(rng, 12) for _ in range(5)]
        at = 1000 * case
        rows += [(at + k, f"{words(rng, 40)} {' '.join(lines)} {words(rng, 40)}") for k in range(2)]
        rows += [(at + 10 + k, f"{words(rng, 40)} {lines[k % 5]} {words(rng, 40)}") for k in range(500)]
        wanted |= {at, at + 1}
    assert {r["doc"] for r in repeated_passages(frame(spark, rows)).collect()} == wanted


def around_line(rng, line, edit):
    """A passage of 60 words around a line: with ``edit`` every fifth other word is replaced, those beside the line too."""
    words_of = words(rng, 44).split()
    low, high = words_of[:22], words_of[22:]
    changed = lambda part, at: [rng.choice(VOCABULARY) if i in at else w for i, w in enumerate(part)]
    both = [(low, high), (changed(low, edit), changed(high, [21 - i for i in edit]))]
    return [" ".join([*left, line, *right]) for left, right in both]


@pytest.mark.parametrize("tile", [64, 2048])
def test_no_link_is_lost_in_a_crowd(spark, monkeypatch, tile):
    """Two texts whose only shared seeds many others hold, which stand between them, be they in one tile or several."""
    monkeypatch.setattr(substring, "TILE", tile)
    rng = random.Random(26)
    line = words(rng, 16)
    rows = [(1000 + i, f"{words(rng, 70)} {line} {words(rng, 70)}") for i in range(400)]
    pairs = [around_line(rng, line, (5, 9, 13, 17, 21)) for _ in range(20)]
    rows += [(2 * i + k, f"{words(rng, 70)} {part} {words(rng, 70)}") for i, pair in enumerate(pairs) for k, part in enumerate(pair)]
    rows += [(500, rows[-1][1]), (501, rows[-1][1]), (500, rows[-1][1])]
    got = {r["doc"]: (r["class_id"], r["n_links"]) for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {d: (min(d, 39) // 2 * 2, 1) for d in [*range(40), 500, 501]}


def test_later_occurrences_of_a_seed(spark):
    """A passage around the sixth or seventh occurrence of a line meets one around the other text's only occurrence."""
    rng = random.Random(27)
    line = words(rng, 16)
    (one, other), (two, another) = (around_line(rng, line, (5, 9, 13, 17, 21)) for _ in range(2))
    held = " ".join(f"{words(rng, 70)} {line} {words(rng, 70)}" for _ in range(5))
    rows = [(1, f"{held} {one} {words(rng, 70)} {two}"), (2, f"{words(rng, 70)} {other}"), (3, f"{another} {words(rng, 70)}")]
    # Crowds of the later occurrences too, which have hashes of their own.
    rows += [(10 + i, " ".join(f"{words(rng, 70)} {line}" for _ in range(7))) for i in range(10)]
    assert {r["doc"]: r["class_id"] for r in repeated_passages(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1}


def test_tile_passages():
    """The same components as of all pairs, aligned one by one."""
    rng = random.Random(28)
    line = words(rng, 16)
    texts = [f"{words(rng, 70)} {line} {words(rng, 70)}" for _ in range(30)]
    for _ in range(15):
        texts += [f"{words(rng, 20)} {part} {words(rng, 20)}" for part in around_line(rng, line, rng.sample(range(22), rng.choice((2, 4, 5, 6))))]
    texts += ["and " * 70 + line + " and" * 70, "and " * 50 + line + " or" * 70]
    hashes = [word_hashes(t) for t in texts]
    key = sorted(set.intersection(*(set(seeds(h)[0].tolist()) for h in hashes)))[0]
    at = [int(p[h.tolist().index(key)]) for h, p in map(seeds, hashes)]
    before, after = substring.contexts(hashes, [np.array([i]) for i in at])
    n = len(texts)
    got = substring.tile_passages(np.arange(n), np.arange(n), np.zeros(n), after, before, np.array(at), hashes)
    lists = [h.tolist() for h in hashes]
    slow = [(x, y) for x in range(n) for y in range(x + 1, n) if passages(lists[x], lists[y], 0, 0, [(at[x], at[y])])]
    assert len(slow) > 10 and roots((x, y) for x, y, _ in got) == roots(slow)
    assert all(spans == passages(lists[x], lists[y], 0, 0, [(at[x], at[y])]) for x, y, spans in got)
    # Of one group, one text or one of two sides nothing is compared.
    for group, text, side in ((np.zeros(n), np.arange(n), np.zeros(n)), (np.arange(n), np.zeros(n), np.zeros(n)), (np.arange(n), np.arange(n), np.arange(n) >= n - 1)):
        found = substring.tile_passages(group, text, side, after, before, np.array(at), hashes)
        assert all(y == n - 1 for _, y, _ in found) and (len(found) == 0 or side.any())


def test_crowd_of_few_words(monkeypatch):
    """Texts of three words at random around a line share most of their words but no passage: next to none is aligned for that."""
    rng = random.Random(31)
    line = words(rng, 16)
    few = lambda n: " ".join(rng.choice(("no", "yes", "or")) for _ in range(n))
    hashes = [word_hashes(f"{few(57)} {line} {few(57)}") for _ in range(60)]
    hashes += [word_hashes(f"{words(rng, 20)} {part}") for part in around_line(rng, line, (5, 9, 13, 17))]
    key = sorted(set.intersection(*(set(seeds(h)[0].tolist()) for h in hashes)))[0]
    at = np.array([int(p[h.tolist().index(key)]) for h, p in map(seeds, hashes)])
    before, after = substring.contexts(hashes, [np.array([i]) for i in at])
    lists, n = [h.tolist() for h in hashes], len(hashes)
    slow = [(x, y) for x in range(n) for y in range(x + 1, n) if passages(lists[x], lists[y], 0, 0, [(at[x], at[y])])]
    aligned = []
    monkeypatch.setattr(substring, "passages", lambda *a: (aligned.append(1), passages(*a))[1])
    found = substring.tile_passages(np.arange(n), np.arange(n), np.zeros(n), after, before, at, hashes)
    assert (n - 2, n - 1) in slow and roots((x, y) for x, y, _ in found) == roots(slow)
    assert len(aligned) <= 2 * len(slow) + 10
    # Two crowds in one call: each has the links it has alone, though their rows are of the same texts and groups.
    half = np.arange(n) % 2
    both = substring.tile_passages(np.arange(n) // 2, np.arange(n) // 2, np.zeros(n), after, before, at, hashes, half)
    alone = [np.flatnonzero(half == k) for k in range(2)]
    apart = [substring.tile_passages(k // 2, k // 2, np.zeros(len(k)), after[k], before[k], at[k], [hashes[i] for i in k]) for k in alone]
    assert apart[0] and sorted(both) == sorted((int(k[x]), int(k[y]), spans) for k, links in zip(alone, apart) for x, y, spans in links)


def test_followed_word_by_word():
    """The same places as of ``_reach``, for rows of any length, and no passage is called impossible."""
    rng = random.Random(32)
    rows, at = [], []
    for _ in range(200):
        base = [rng.randrange(4) if len(rows) % 3 else rng.randrange(90) for _ in range(rng.choice((4, 9, 60, 130)))]
        spot = rng.randrange(len(base) - 3)
        for edit in (0, rng.choice((0.03, 0.1, 0.15))):
            sides = [[w if rng.random() >= edit else rng.randrange(90) for w in part if rng.random() >= edit / 2] for part in (base[:spot], base[spot + 4 :])]
            rows.append(np.array([*sides[0], 901, 902, 903, 904, *sides[1]], np.uint32))
            at.append(len(sides[0]))
    one, two = np.array([(k, rng.randrange(400)) if k % 5 == 0 else (k, k ^ 1) for k in range(400)]).T
    sides, lists = substring._sides(rows, np.array(at)), [r.tolist() for r in rows]
    for side, part in zip(sides, (lambda k: lists[k][: at[k]][::-1], lambda k: lists[k][at[k] + 4 :])):
        xs, ys, counts = substring._followed(*side, one, two)
        for k in range(400):
            assert list(zip(xs[k, : counts[k]].tolist(), ys[k, : counts[k]].tolist())) == substring._reach(part(one[k]), part(two[k]))
    wanted = np.array([bool(passages(lists[x], lists[y], 0, 0, [(at[x], at[y])])) for x, y in zip(one, two)])
    possible = substring._possible(sides, one, two)
    assert wanted.sum() > 30 and not (wanted & ~possible).any() and (~possible).sum() > 30


@pytest.mark.parametrize("split", [0, 25])
def test_tokens_held_too(split, monkeypatch):
    """Shared tokens count as often as both rows hold them, in blocks of one row or many, for frequent tokens and rare ones."""
    rng = random.Random(33)
    held = [[rng.choice((rng.randrange(3), rng.randrange(400))) for _ in range(40)] for _ in range(60)]
    rows, tokens = np.repeat(np.arange(60), 40), np.concatenate(held)
    for cells in (1, 1 << 20):
        monkeypatch.setattr(substring, "_COUNTS", cells)
        got = {(low + x, (split or low) + y): c for low, counts in substring._held_too(rows, tokens, 60, split) for (x, y), c in np.ndenumerate(counts)}
        pairs = [(x, y) for x in range(split or 60) for y in range(split or x + 1, 60)]
        assert all(got[x, y] == sum((Counter(held[x]) & Counter(held[y])).values()) for x, y in pairs)


def test_seeds_of_many_texts():
    """Texts cut into seeds together have the seeds that each has alone."""
    rng = random.Random(34)
    texts = [word_hashes(rng.choice((words, lambda r, n: "and or " * (n // 2)))(rng, rng.randrange(60))) for _ in range(80)]
    own, h, spot = substring.seeds_of(texts)
    for k, t in enumerate(texts):
        assert [z.tolist() for z in seeds(t)] == [h[own == k].tolist(), spot[own == k].tolist()]


def test_large_fuzzy_group(spark):
    """Each text that has a partner of similarity 0.8 by brute force is found in a crowd of edited copies."""
    rng = random.Random(22)
    base = words(rng, 100).split()
    edited = [[rng.choice(VOCABULARY) if rng.random() < 0.08 else w for w in base] for _ in range(300)]
    rows = [(i, f"{words(rng, 30)} {' '.join(e)} {words(rng, 30)}") for i, e in enumerate(edited)]
    wanted = {i for i, e in enumerate(edited) if any(sum(u == v for u, v in zip(e, o)) >= 80 for o in edited if o is not e)}
    got = {r["doc"]: r["class_id"] for r in repeated_passages(frame(spark, rows)).collect()}
    assert wanted <= set(got) and {got[i] for i in wanted} == {0}


def test_one_seed_is_enough(spark):
    """A passage of 60 words whose only run of 16 equal words lies at its start, its end or in its middle."""
    rng = random.Random(23)
    rows = []
    for case in range(45):
        passage = words(rng, 60).split()
        low = (0, 22, 44)[case % 3]
        edited = [f"x{case}x{i}" if i % 5 == 2 and not low <= i < low + 16 else w for i, w in enumerate(passage)]
        rows += [(2 * case, f"{words(rng, 40)} {' '.join(passage)} {words(rng, 40)}"), (2 * case + 1, f"{words(rng, 70)} {' '.join(edited)} {words(rng, 9)}")]
    assert {r["doc"] for r in repeated_passages(frame(spark, rows)).collect()} == {d for d, _ in rows}


def test_passage_held_twice(spark):
    """Both copies of a passage in one text are spans, and a cut or jumbled first copy doesn't hide the second."""
    rng = random.Random(24)
    one, two, three = (words(rng, 70) for _ in range(3))
    lines = [two.split()[i : i + 10] for i in range(0, 70, 10)]
    jumbled = " ".join(" ".join(lines[i]) for i in (6, 2, 4, 0, 5, 3, 1))
    rows = [
        (1, f"{words(rng, 20)} {one} {words(rng, 30)} {one} {words(rng, 20)}"),
        (2, f"{words(rng, 15)} {one} {words(rng, 20)}"),
        (3, f"{jumbled} {words(rng, 30)} {two} {words(rng, 20)}"),
        (4, f"{words(rng, 15)} {two} {words(rng, 20)}"),
        (5, f"{' '.join(three.split()[:35])} {words(rng, 30)} {three} {words(rng, 20)}"),
        (6, f"{words(rng, 15)} {three} {words(rng, 20)}"),
    ]
    got = {r["doc"]: [tuple(s) for s in r["spans"]] for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {1: [(20, 90), (120, 190)], 2: [(15, 85)], 3: [(100, 170)], 4: [(15, 85)], 5: [(65, 135)], 6: [(15, 85)]}


def test_line_held_very_often(spark):
    """The pairs of a line that two texts repeat grow with its occurrences, and the whole stretch is found."""
    rng = random.Random(25)
    line = words(rng, 12)
    rows = [(1, f"{words(rng, 20)} {' '.join([line] * 400)}"), (2, " ".join([line] * 400))]
    assert seed_pairs(spark.createDataFrame(rows, "digest long, text string")).count() < 4000
    got = {r["doc"]: r["n_repeated"] for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {1, 2} and min(got.values()) >= 4750


def test_fuzzy_recall(spark):
    """Of passages of 80 words with every n-th one replaced, at least nine in ten are found: down to a similarity of 0.83."""
    rng = random.Random(41)
    rows, kinds = [], {}
    for n in (20, 14, 10, 8, 7, 6):
        for _ in range(50):
            passage = words(rng, 80).split()
            edited = [rng.choice(VOCABULARY) if j % n == n - 1 else w for j, w in enumerate(passage)]
            for part in (passage, edited):
                kinds[len(rows)] = n
                rows.append((len(rows), f"{words(rng, 60)} {' '.join(part)} {words(rng, 50)}"))
    got = [kinds[r["doc"]] for r in repeated_passages(frame(spark, rows)).select("doc").collect()]
    assert all(got.count(n) >= 90 for n in set(kinds.values())), {n: got.count(n) for n in set(kinds.values())}


def test_runs_of_one_word(spark):
    """A run of 50 equal words, which has but one seed, is found where two texts hold it."""
    rng = random.Random(42)
    rows = [(i, f"{words(rng, 20 + i)} {'and ' * (55 + i)}{words(rng, 20)}") for i in range(6)] + [(9, words(rng, 90))]
    assert {r["doc"] for r in repeated_passages(frame(spark, rows)).collect()} == set(range(6))


@pytest.mark.parametrize("hot_keys", [0, 3, 10_000])
def test_join_hot(spark, monkeypatch, hot_keys):
    """The same rows whether no key, some or all count as hot."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), ("c", 3)], "k string, v int")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.upper("k"))
    got = common.join_hot(rows, side, "k").select("k", "v", "of").collect()
    assert sorted(map(tuple, got)) == sorted((r["k"], r["v"], r["k"].upper()) for r in rows.collect())


def test_fingerprints_are_spread(spark):
    """Each becomes 64 rows, so the exchange before that must stay, though they were grouped by fingerprint."""
    prints = spark.range(100).withColumnRenamed("id", "fp").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select("fp")
    seen = []
    original = simhash.checkpointed
    simhash.checkpointed = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), original(df))[1]
    try:
        near_links(prints)
    finally:
        simhash.checkpointed = original
    assert seen[0].count("REPARTITION_BY_NUM") >= 1


def longest_common(x, y):
    row = [0] * (len(y) + 1)
    for word in x:
        before = 0
        for j, other in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if word == other else max(row[j], row[j - 1])
    return row[-1]


def test_passages_of_the_corpus(spark):
    """Every run of 50 words that two texts of sf0.001 share is found on both sides, and every passage is one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    holders, tokens = defaultdict(set), {}
    for doc, text in docs.collect():
        tokens[doc] = text.encode().lower().split()
        for i in range(len(tokens[doc]) - 49):
            holders[b" ".join(tokens[doc][i : i + 50])].add(doc)
    expected = set().union(*(h for h in holders.values() if len(h) > 1))
    assert expected <= {r["doc"] for r in repeated_passages(docs).select("doc").collect()}
    keyed, links = passage_links(docs)
    of = {r["digest"]: r["doc"] for r in keyed.collect()}
    for r in links.collect():
        one, two = tokens[of[r["a"]]][r["a_start"] : r["a_end"]], tokens[of[r["b"]]][r["b_start"] : r["b_end"]]
        assert min(len(one), len(two)) >= 50 and longest_common(one, two) >= 0.8 * max(len(one), len(two))


@pytest.mark.parametrize("split", [0, 13])
def test_rows_that_share_tokens_meet(split, monkeypatch):
    """No pair that shares enough is lost, whether rows meet at rare tokens or all are counted, and rare ones cost few meetings."""
    rng = np.random.RandomState(29)
    for words_in_all, budget in ((40, 4), (40, 1 << 20), (4000, 4)):
        monkeypatch.setattr(substring, "_MEETINGS", budget)
        monkeypatch.setattr(substring, "_COUNTS", 300)
        held = [np.r_[np.arange(12), rng.zipf(1.3, 50) % words_in_all] for _ in range(60)]
        held[40:50] = [np.r_[held[k][:45], rng.randint(0, words_in_all, 5)] for k in range(10)]
        rows, tokens = np.repeat(np.arange(60), [len(h) for h in held]), (np.concatenate(held).astype(np.uint64) + np.uint64(1)) * substring._ODD[0]
        shared = lambda x, y: sum((Counter(held[x].tolist()) & Counter(held[y].tolist())).values())
        first, second = (range(split), range(split, 60)) if split else (range(60), range(60))
        enough = {(x, y) for x in first for y in second if x < y and shared(x, y) >= 19}
        group, got, offered = np.arange(60), set(), set()
        for xs, ys in substring._sharing(rows, tokens, 60, split, 19, group, lambda x, y: np.ones(len(x), bool)):
            for x, y in zip(xs.tolist(), ys.tolist()):
                offered.add((x, y))
                if (x, y) in enough and group[x] != group[y]:
                    got.add((x, y))
                    group[group == group[y]] = group[x]
        assert enough and roots(got) == roots(enough)
        assert all(x < y and (not split or x < split <= y) for x, y in offered)


def test_lone_runs_are_as_aligned():
    """A chain within one run of matching words gives what the alignment gives."""
    rng = random.Random(31)
    left, right, begins, spots = [], [], [[], []], []
    for n in range(300):
        run = words(rng, rng.choice((20, 45, 49, 50, 60))).split()
        ends = [[*words(rng, rng.randint(0, 30)).split()] for _ in range(4)]
        if n % 3 == 0:
            ends[1][2:5] = ends[3][1:4] = run[:3]
        a, b = word_hashes(" ".join(ends[0] + run + ends[1])), word_hashes(" ".join(ends[2] + run + ends[3]))
        left.append(a)
        right.append(b)
        begins[0].append(n)
        begins[1].append(2 * n)
        spots.append([(len(ends[0]) + k + n, len(ends[2]) + k + 2 * n) for k in sorted(rng.sample(range(16), rng.choice((1, 2))))])
    kind = pa.list_(pa.struct([("a_spot", pa.int32()), ("b_spot", pa.int32())]))
    chain = pa.array([[{"a_spot": x, "b_spot": y} for x, y in c] for c in spots], kind)
    ended, firsts, runs = substring._lone_runs([left, right], begins, chain)
    assert 100 < sum(ended) < 300
    for n in range(300):
        if ended[n]:
            slow = passages(left[n].tolist(), right[n].tolist(), n, 2 * n, spots[n])
            a0, b0 = firsts[0][n], firsts[1][n]
            assert slow == ([(a0, a0 + runs[n], b0, b0 + runs[n], runs[n])] if runs[n] >= 50 else [])
    # Seeds where all texts begin have no words before them.
    assert substring._lone_runs([[left[0]], [left[0]]], [[0], [0]], pa.array([[{"a_spot": 0, "b_spot": 0}]], kind))[2] == [len(left[0])]


def test_near_copies_are_linked_without_pairs_of_words(monkeypatch):
    """Chains with gaps give what the alignment of each gives, which is made only where parts of one may be passages."""
    rng = random.Random(37)
    left, right, chained, expected = [], [], [], []
    for n in range(300):
        a = words(rng, 150).split()
        b = [w if rng.random() > 0.01 * (n % 30) else "other" for w in a]
        if n % 3 == 0:
            del b[60 : 60 + n % 7]
        if n % 5 == 0:
            b[70:70] = words(rng, n % 90 + 1).split()
        x, y = (word_hashes(" ".join(z)) for z in (a, b))
        spots = [(int(i), int(j)) for h, i in zip(*seeds(x)) for g, j in zip(*seeds(y)) if h == g]
        for chain in chains(*np.array(spots).T) if spots else []:
            starts = [max(0, z - substring.MARGIN) for z in chain[0]]
            u, v = (z[k : e + substring.KMER + substring.MARGIN] for z, k, e in zip((x, y), starts, chain[-1]))
            left.append({"start": starts[0], "words": u.tobytes()})
            right.append({"start": starts[1], "words": v.tobytes()})
            chained.append([{"a_spot": i, "b_spot": j} for i, j in chain])
            expected += [(len(left), *p[:4], p[4] / max(p[1] - p[0], p[3] - p[2])) for p in passages(u.tolist(), v.tolist(), *starts, chain)]
    side = pa.struct([("start", pa.int32()), ("words", pa.binary())])
    number = pa.array(range(1, len(left) + 1), pa.int64())
    columns = [number, number, pa.array(left, side), pa.array(right, side), pa.array(chained, pa.list_(pa.struct([("a_spot", pa.int32()), ("b_spot", pa.int32())])))]
    aligned = []
    monkeypatch.setattr(substring, "passages", lambda *a: (aligned.append(1), passages(*a))[1])
    (found,) = substring._link_rows(iter([pa.RecordBatch.from_arrays(columns, names=["a", "b", "left", "right", "chain"])]))
    got = [tuple(row[c] for c in found.schema.names if c != "b") for row in found.to_pylist()]
    assert sorted(got) == sorted(expected) and len(got) > 100
    assert 0 < len(aligned) < len(got) * 2 // 3


def test_common_words_are_as_many_as_aligned():
    rng = random.Random(41)
    for n in range(300):
        x, y = ([rng.randrange(1 + n % 9) for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert substring._common(x, y) == len(substring._align(x, y))


def test_nothing_exploded_is_broadcast(spark):
    """However small Spark takes a table for: its size is guessed from before the explode."""
    fps = spark.createDataFrame([(k,) for k in range(5)], "fp bigint")
    plans, held = [], simhash.checkpointed
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(simhash, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or held(df))
        plans.append(near_links(fps, light=2)._jdf.queryExecution().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in plans)


def test_no_side_of_similar_texts_is_broadcast(spark, monkeypatch):
    """Sets of shingles are far larger than Spark takes them for."""
    docs = spark.createDataFrame([(k, f"{'a b c d e f g h ' * 4}{k // 2}") for k in range(6)], "doc_id bigint, text string")
    prints, signed = simhash.fingerprints(docs), near_copies.signatures(docs)
    plans, held = [], near_copies.checkpointed
    monkeypatch.setattr(near_copies, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or held(df))
    near_copies.similar_links(docs, prints, signed, 0.8)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_words_inserted_again_and_again(spark):
    # Of the 16 words beside a seed few are in step, yet four of five words match.
    rng = np.random.RandomState(3)
    rows, expected = [], set()
    for k in range(60):
        passage, other, *around = (rng.randint(0, 1 << 30, n).astype(str).tolist() for n in (60, 60, 80, 80, 80, 80))
        longer = [w for i, word in enumerate(passage) for w in ([word, other[i]] if i % 4 == 3 and i < 59 else [word])]
        a, b = (" ".join([*around[k], *part, *around[k + 1]]) for k, part in ((0, passage), (2, longer)))
        rows += [(2 * k, a), (2 * k + 1, b)]
        x, y = word_hashes(a), word_hashes(b)
        (hash_a, spot_a), (hash_b, spot_b) = seeds(x), seeds(y)
        i, j = np.nonzero(hash_a[:, None] == hash_b)
        matched = chains(spot_a[i], spot_b[j]) if len(i) else []
        if any(passages(x.tolist(), y.tolist(), 0, 0, chain) for chain in matched):
            expected |= {2 * k, 2 * k + 1}
    assert len(expected) > 80
    found = repeated_passages(frame(spark, rows)).collect()
    assert {r["doc"] for r in found} == expected


def test_rows_of_a_tile_need_no_like_context():
    rng = np.random.RandomState(5)
    met = unlike = 0
    for _ in range(200):
        passage = rng.randint(0, 1 << 32, 60, np.int64).astype(np.uint32)
        longer = [w for i, word in enumerate(passage) for w in [word, *rng.randint(0, 1 << 32, int(i % 4 == 3), np.int64).astype(np.uint32)]]
        sides, at = [passage, np.array(longer, np.uint32)], np.array([28, 35])
        before, after = substring.contexts(sides, [at[:1], at[1:]])
        spans = passages(*(x.tolist() for x in sides), 0, 0, [(28, 35)])
        found = substring.tile_passages(np.arange(2), np.arange(2), np.zeros(2), after, before, at, sides)
        assert [f[2] for f in found] == [spans] * bool(spans)
        met += bool(spans)
        unlike += bool(spans) and not (substring._alike(after[:1], after[1:]) | substring._alike(before[:1], before[1:]))[0]
    assert met > 100 and unlike


def test_join_hot_broadcasts_hot_keys_alone(spark):
    # Spark takes both sides for small; what is not hot may be any size.
    rows = spark.range(40).selectExpr("id % 20 as k", "id as v")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plan = common.join_hot(rows, side, "k")._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    assert len(re.findall(r"BroadcastHashJoin", plan)) == 2 and "SortMergeJoin" in plan
