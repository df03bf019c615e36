"""Fingerprints, n-gram join, substring dedup against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from fixtures import SMALL
from pyspark.sql import functions as F

from quarry.llm import components, fingerprint, ngram_join, substring
from quarry.llm.common import table

PARAGRAPH = re.compile(fingerprint.PARAGRAPH.replace(r"\z", r"\Z"))


def pieces(t):
    return set(PARAGRAPH.findall(t or ""))


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(df):
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted((tuple(r) for r in fingerprint.fingerprints(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want, prints = [], defaultdict(set)
    for i, (d, t) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        edited = t[:len(t) - k] + after[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after)))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r[0], r[1], r[2], pytest.approx(r[5]), pytest.approx(r[6])) for r in got] == want
    for (d, t), r in zip(rows, got):
        prints[t].add(r[3]) if rows.count((d, t)) == 1 and sum(x[0] == d for x in rows) == 1 else None
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints(spark, odd):
    check_fingerprints(table(spark, SMALL, "documents").limit(60).select("doc_id", "text").cache())
    check_fingerprints(odd)


def test_fingerprints_empty_and_single(make, none):
    assert fingerprint.fingerprints(none).count() == 0
    r = fingerprint.fingerprints(make([(1, "abcdefgh" * 30, "s")])).first()
    assert r.near_next == 1.0


def test_peeling_recovers_what_differs(spark):
    a, b = list(range(100, 140)), list(range(103, 142))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    h = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    cells = lambda c: fingerprint._cells(fingerprint.signed_items(h(F.col(c)), 1), F.lit(0))
    got, want = df.select(fingerprint.peel(fingerprint.subtract(cells("a"), cells("b")), F.lit(0)), F.array_union(F.array_except(h(F.col("a")), h(F.col("b"))), F.array_except(h(F.col("b")), h(F.col("a"))))).first()
    assert got is None or sorted(got) == sorted(want)


def test_differences_of_all_sizes_are_exact(spark):
    r, rows = random.Random(4), []
    for n, m, common in [(0, 0, 0), (1, 0, 0), (0, 1, 5), (1, 1, 0), (3, 4, 500), (12, 0, 9), (40, 40, 40), (700, 3, 10), (900, 900, 100), (0, 0, 2000), (2500, 1, 0)]:
        x = [r.getrandbits(64) - (1 << 63) for _ in range(n + m + common)]
        rows.append((x[:n + common], x[n:], n + m))
    df = spark.createDataFrame(rows, "own_items array<long>, other_items array<long>, want int")
    for c in ("own", "other"):
        df = df.withColumns({f"{c}_cells": fingerprint._cells(fingerprint.signed_items(F.col(f"{c}_items"), 1), F.lit(0)), f"{c}_parities": fingerprint.parities(F.col(f"{c}_items"))})
    about = fingerprint.estimate(F.col("own_parities"), F.col("other_parities"), F.size("own_items") + F.size("other_items"))
    for want, got, guess in fingerprint.with_difference(df.withColumn("guess", about), "own", "other", "got").select("want", "got", "guess").collect():
        assert got == want and (want < 10 or 0.4 * want <= guess <= 2.5 * want)


def test_an_inserted_character_changes_one_paragraph(make):
    r = random.Random(6)
    text = " ".join(" ".join(f"w{r.randrange(10**5)}" for _ in range(r.randint(5, 20))) + "." for _ in range(300))
    assert len(pieces(text) ^ pieces("x" + text)) <= 6 and len(pieces(text)) > 50


def test_likeness_follows_from_the_fingerprints_alone(spark):
    got = fingerprint.fingerprints(table(spark, SMALL, "documents").select("doc_id", "text")).orderBy("doc_id").collect()
    digests = lambda f: set(f.split(":")[2].split(",")) - {""}
    for x, after in zip(got, [*got[1:], got[0]]):
        for f, near in ((x.edited_fingerprint, x.near_edited), (after.fingerprint, x.near_next)):
            a, b = digests(x.fingerprint), digests(f)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert len(f.split(":")[1].split(",")) == fingerprint.CELLS


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check_join(rows, df):
    sets = {i: shingles(t) for i, t, _ in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def versions(r, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join(make):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    base, passage = [word() for _ in range(80)], [word() for _ in range(40)]
    texts = versions(r, 60, base, 4) + [" ".join(base)] * 20 + [" ".join(base).upper()]
    texts += [" ".join(passage + [word() for _ in range(r.randint(0, 40))]) for _ in range(50)]
    texts += [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(60)] + ["", None, " \t\n", "a b c", "A B\nC", "a b c d"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    check_join(rows, make(rows))


def test_join_odd(odd, none, make):
    got = [tuple(x) for x in ngram_join.jaccard_components(odd).collect()]
    assert sorted(x for x in got if x[0] in (4, 5)) == [(4, 1, 4), (4, 1, 4), (5, 30_000 - 4 - (30_000 - 4 - len(shingles(odd.where("doc_id = 5").first().text))), 5)]
    assert {x[:2] for x in got} >= {(1, 0), (2, 0), (3, 0)} and ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.first_of_groups(odd)
    assert kept.columns == odd.columns and sorted((x.doc_id is not None, x.doc_id) for x in kept.collect()) == [(False, None)] + [(True, i) for i in range(1, 7)]


def test_substrings(make, odd, none):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**5)}"
    shared = [[word() for _ in range(51 + 7 * i)] for i in range(6)]
    rows, holds = [], defaultdict(set)
    for i in range(60):
        w = [word() for _ in range(r.randint(30, 200))]
        if i < 30:
            p = r.randrange(6)
            at = r.randrange(len(w))
            w[at:at] = shared[p]
            holds[p].add(i)
        rows.append((i, "".join(x + r.choice(" \n ") for x in w).strip(), "s"))
    got = substring.repeated_spans(make(rows)).collect()
    want = {i for d in holds.values() if len(d) > 1 for i in d}
    assert {x.doc_id for x in got} == want, "all that share, and no others"
    for x in got:
        assert 0 <= x.start < x.end <= len(rows[x.doc_id][1])
    # paragraphs that reach beyond a passage may have another first document
    assert {x.doc_id for x in got if not x.removed} >= {min(d) for d in holds.values() if len(d) > 1}, "the first one stays"
    assert substring.repeated_spans(none).count() == 0 and substring.repeated_spans(odd).count() == 0


def planted(passages, seed=3):
    """Rows of documents with a passage each between random words; where each passage lies (code points)."""
    r, rows, at = random.Random(seed), [], []
    for i, p in enumerate(passages):
        left, right = (" ".join(f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 60))) for _ in range(2))
        body = " ".join(p)
        rows.append((i, f"{left} {body} {right}", "s"))
        at.append((len(left) + 1, len(left) + 1 + len(body)))
    return rows, at


def covered(spans, doc, a, b, removed=(True, False)):
    return set(range(a, b)) <= {p for x in spans if x.doc_id == doc and x.removed in removed for p in range(x.start, x.end + 1)}


def test_near_paragraphs_of_whole_length(make):
    r, rows, changed = random.Random(8), [], []
    word = lambda: f"w{r.randrange(10**6)}"
    for i in range(40):
        p = [word() for _ in range(r.choice((52, 60)))]
        q = list(p)
        q[r.randrange(15, len(p) - 15)] = "changed"
        for j, x in enumerate((p, q)):
            head = " ".join(word() for _ in range(30))
            changed.append((len(head) + 1, len(head) + 1 + len(" ".join(x))))
            rows.append((2 * i + j, f"{head}\n{' '.join(x)}\n{' '.join(word() for _ in range(9))}", "s"))
    got = substring.repeated_spans(make(rows)).collect()
    assert all(covered(got, d, *changed[d], removed=(d % 2 == 1,)) for d in range(80))
    assert all((x.start, x.end) == changed[x.doc_id] for x in got)


def test_periodic_passages(make):
    r, passages = random.Random(9), []
    for period in (1, 2, 3, 4, 5, 6, 11) * 5:
        unit = [f"p{r.randrange(10**6)}" for _ in range(period)]
        passages += [[unit[k % period] for k in range(60)]] * 2
    rows, at = planted(passages)
    got = substring.repeated_spans(make(rows)).collect()
    assert {x.doc_id for x in got} == set(range(len(rows)))


@pytest.mark.parametrize("length", [51, 100])
def test_runs_are_covered_to_their_borders(make, length):
    r, passages = random.Random(length), []
    for i in range(40):
        unit = [f"p{r.randrange(10**6)}" for _ in range(length if i % 4 else 1 + i // 8)]
        passages += [[unit[k % len(unit)] for k in range(length)]] * 2
    rows, at = planted(passages)
    got = substring.repeated_spans(make(rows)).collect()
    for d in range(len(rows)):
        assert covered(got, d, *at[d])
    assert all((x.start, x.end) == at[x.doc_id] for x in got if x.doc_id % 2)


def test_bands_are_tuned():
    for percent, recall in ((75, 0.99), (75, 0.9), (90, 0.999), (50, 0.95)):
        bands, rows = substring.tuned(percent, recall)
        assert bands <= 10 and 1 - (1 - (percent / 100) ** rows) ** bands >= recall
        assert rows == 16 or 1 - (1 - (percent / 100) ** (rows + 1)) ** 10 < recall, "one row more would ask for more bands"
    assert substring.tuned(75, 0.99) == (9, 3)


def test_near_paragraphs_against_all_pairs(make):
    """Recall over all pairs of paragraphs of 0.75 or more; nothing below; short passages and partitions change nothing."""
    r, rows = random.Random(11), []
    word = lambda: f"w{r.randrange(10**6)}"
    short = " ".join(word() for _ in range(34))
    for i in range(120):
        p = [word() for _ in range(r.randint(60, 90))]
        q = list(p)
        for at in r.sample(range(len(p) // 50, len(p)), r.randint(1, 4)):
            q[at] = word()
        for j, x in enumerate((p, q)):
            rows.append((2 * i + j, " ".join(word() for _ in range(20)) + "\n" + " ".join(x) + "\n" + " ".join(word() for _ in range(30)), "s"))
    for i in range(240, 300):
        rows.append((i, " ".join(word() for _ in range(40)) + " " + short + " " + " ".join(word() for _ in range(40)), "s"))
    paras = {i: shingles(t.split("\n")[1]) for i, t, _ in rows if i < 240}
    runs = lambda i: set(zip(*[rows[i][1].split("\n")[1].split()[k:] for k in range(51)]))
    alike, near, apart = {}, [], []
    for a in range(0, 240, 2):
        s, t = paras[a], paras[a + 1]
        alike[a] = len(s & t) / len(s | t)
        (near if alike[a] >= 0.75 else apart).append(a)
    assert len(near) >= 40 and len(apart) >= 20
    found = substring.repeated_spans(make(rows)).collect()
    docs = {x.doc_id for x in found}
    assert sum({a, a + 1} <= docs for a in near) >= 0.95 * len(near)
    assert not [a for a in apart if {a, a + 1} & docs and not runs(a) & runs(a + 1)], "less alike, and no run of 51 words"
    assert not [d for d in docs if d >= 240], "passages of 34 words are left alone"
    assert sorted(map(tuple, substring.repeated_spans(make(rows, 7)).collect())) == sorted(map(tuple, found))


def test_seeds_depend_on_the_text_alone():
    r = random.Random(13)
    how = substring.Paragraphs()
    text = " ".join(f"w{r.randrange(50)}" for _ in range(200)).encode()

    def own(before, after):
        found = substring.Found([*before, text, *after], how)
        k = len(before)
        start, end = found.paragraphs()
        return [int(p - found.first[k]) for p in found.seeds() if found.text[p] == k], [(int(a - found.first[k]), int(b - found.first[k])) for a, b in zip(start, end) if found.text[a] == k]

    alone = own([], [])
    for _ in range(60):
        others = lambda: [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice((0, 3, 39, 40, 45, 51, 90)))).encode() for _ in range(2)]
        assert own(others(), others()) == alone


def test_keys_are_packed_in_small_rows():
    """A worker holds half a million keys at once, and loses none."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30_000)) for i in range(40)]
    batches = list(ngram_join._sign(5, 8)([pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]))
    blobs = [[len(b) for b in x.column("keys").to_pylist() if b is not None] for x in batches]
    assert sum(map(sum, blobs)) == 5 * 40 * 29_996 and max(map(sum, blobs)) < 4 << 20
