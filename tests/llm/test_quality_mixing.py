"""Host rules and mixing against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from fixtures import SMALL

from quarry.llm import mixing, quality
from quarry.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark, odd):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in quality.count_columns(rows).collect():
        assert tuple(r[n] for n in NAMES) == counts(r.text), r.doc_id


def test_hosts(make):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 10 else bad, "good") for i in range(200)] + [(1000 + i, good if i % 10 == 0 else bad, "spam") for i in range(200)]
    rows += [(5000, good, "new"), (5001, bad, "tiny")]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (i % 10 != 0) for i in range(200)), "a good host loses its own failures only"
    assert not any(got[1000 + i].kept for i in range(200)), "a bad host loses its good documents too"
    assert got[5000].kept and not got[5001].kept, "one document doesn't condemn or save a host"


def test_odd_rows_and_empty(odd, none):
    got = quality.judge(odd, keep=["doc_id"])
    assert got.columns == ["doc_id", *NAMES, "base_failed", "kept"] and got.count() == 8
    assert {r.doc_id: r.base_failed for r in got.collect()}[5] is False
    assert quality.judge(none).count() == 0


def targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= level * w[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            open_.remove(s)
    return out


def check_mix(rows, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(WORD.findall(t or ""))
        size[s] += n
        largest[s] = max(largest[s], n)
    want, took = targets(size), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        took[r.source] += r.copies * r.size
    for s in size:
        assert abs(took[s] - want[s]) <= largest[s] + 1e-6
    return sorted((r.doc_id or -1, r.mark, r.size, r.copies) for r in got)


def test_mix(spark, make):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), (None, "b", "a", "é", "hot", "hot", "hot")[i % 7]) for i in range(700)]
    assert check_mix(rows, make(rows)) == check_mix(rows, make(rows, 7)), "reruns and partitions change nothing"
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, SMALL, "documents").collect()]
    check_mix(docs, make(docs))


def test_mix_is_unbiased(make):
    rows = [(i, " ".join(["w"] * 10), s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 40)]
    docs, total = make(rows).cache(), Counter()
    for seed in range(3):
        for r in mixing.mix(docs, seed=seed).collect():
            total[r.source, r.copies] += 1
    assert total["c", 1] == 3 * round(targets({"a": 400, "b": 400, "c": 400})["c"] / 10), "shares are exact up to one document"


def test_mix_odd(odd, none):
    assert mixing.mix(odd).count() == 8 and mixing.mix(none).count() == 0
    took = mixing.take(odd)
    assert took.columns == odd.columns and mixing.take(none).count() == 0
    assert {r.doc_id for r in took.collect()} <= {4, 5, 6}


def test_equal_rows_are_made_in_blocks(make, monkeypatch):
    rows = [(1, "a b c", "s")] * 20 + [(None, "x y", None)] * 7 + [(i, "d e f g", "t") for i in range(2, 30)]
    want = check_mix(rows, make(rows))
    taken = Counter(map(tuple, mixing.take(make(rows)).collect()))
    monkeypatch.setattr(mixing, "EQUAL", 3)
    assert check_mix(rows, make(rows)) == want
    assert Counter(map(tuple, mixing.take(make(rows)).collect())) == taken
    assert sum(taken.values()) == sum(r[3] for r in want)
