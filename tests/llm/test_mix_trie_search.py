"""Mixing, the prefix trie and the ranked search against brute force, awkward rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import SCHEMA, prose
from pyspark.sql import functions as F

from tidemark.llm import list_ranking, ranked_search
from tidemark.llm.mixing import mix_plan, mixed_documents
from tidemark.llm.prefix_trie import rebuilt_trie
from tidemark.llm.ranked_search import build_index, no_random_access, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return len(WORD.findall(text or ""))


# 11 ------------------------------------------------------------------------------------------------


def shared_out(sizes, most=3):
    """Targets by sharing again and again; ``sizes`` of the sources in their order."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(got, rows, near):
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += words(t)
    want = shared_out({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s))})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])


def test_mix_of_awkward_rows(docs, rows, clashing, empty):
    for table in (docs, clashing):
        check_mix(mix_plan(table).collect(), rows, near=9001)
    assert mix_plan(empty).collect() == []


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, prose(i, 3 + (i * i) % 197), "en", "hot" if i % 3 == 0 else f"s{i % 11}", 0) for i in range(1500)]
    rows += [(None, prose(1, 30), "en", None, 0)] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    first, again = mix_plan(docs).collect(), mix_plan(docs.repartition(7)).collect()
    check_mix(first, rows, near=31)
    assert Counter(first) == Counter(again)
    assert Counter(first) != Counter(mix_plan(docs, seed="other").collect())
    part = [r for r in first if r.source == "hot"]
    assert len({r.copies for r in part if r.size > 150}) > 1  # longer texts more often, by chance in between
    by_size = [np.mean([r.copies for r in part if lo <= r.size < lo + 100]) for lo in (0, 100)]
    assert by_size[0] < by_size[1]


def test_inclusion_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h", "en", "one" if i < 400 else "two", 0) for i in range(600)], SCHEMA)
    weight = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    counts = Counter()
    for r in mix_plan(docs, weight=weight).where("source = 'one'").collect():
        counts[r.doc_id % 2] += r.copies
    # a third of all words of 600 documents: 200 copies, three of four with an even id
    assert counts[0] + counts[1] == 200 and abs(counts[0] / 200 - 0.75) < 0.06


def test_mixed_documents(docs, rows):
    plan = mix_plan(docs)
    made = mixed_documents(docs, plan)
    want = defaultdict(int)
    for r in plan.collect():
        want[r.doc_id, r.source, r.mark] += r.copies
    got = Counter((r.doc_id, r.source, None if r.text is None else hashlib.md5(r.text.encode()).hexdigest()) for r in made.collect())
    assert got == {k: v for k, v in want.items() if v}
    assert made.columns == [*docs.columns, "copy_no"]


# 12 ------------------------------------------------------------------------------------------------


def trie(rows):
    """``rows`` of (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), role, text))
    said = {c: [(role, text) for _, role, text in sorted(v)] for c, v in own.items()}
    full = {}
    for c in said:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        full[c] = said.get(base, [])[:h] + said[c][h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    below = defaultdict(lambda: [0, 0])
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in kids
            below[p[:d]][1] += (len(m) - 1) * (words(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], *below[p], hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p))).encode()).hexdigest())
        for p, m in members.items()) if full else []


CHATS = "conv_id long, turn long, role string, text string"


def chats():
    rows = []
    for c in range(-30, 230):
        for t in range((c * 7) % 9):
            rows.append((c, t, "user" if t % 2 else "assistant", f"common turn {t}" if (c // 20 + t) % 4 else prose(c + t, 3)))
    rows += [(500, None, None, None), (500, None, "user", "x"), (500, 0, "user", None), (500, 0, "user", None), (500, 3, None, "one two")]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(520, 2 * i, "user", "again") for i in range(2100)] + [(521, 7, "user", f"tie {i}") for i in range(40)]
    return rows


def as_rows(df):
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=lambda r: r[:2])


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "REST", 2000)  # so that the list is contracted several times
    rows = chats()
    table = spark.createDataFrame(rows, CHATS).withColumn("depth", F.lit("x")).withColumn("k0", F.lit("y")).repartition(3)
    assert as_rows(rebuilt_trie(table)) == sorted(trie(rows), key=lambda r: r[:2])


def test_trie_of_nothing(spark):
    assert rebuilt_trie(spark.createDataFrame([], CHATS)).collect() == []
    assert rebuilt_trie(spark.createDataFrame([(None, 1, "a", "b")], CHATS)).collect() == []


def test_list_ranks(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "REST", 200)
    order = np.random.default_rng(5).permutation(900).tolist()
    rows = [(v, order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, v in enumerate(order)]
    got = list_ranking.list_ranks(spark.createDataFrame(rows, "item long, prev long, next long"))
    assert {r.item: r["rank"] for r in got.collect()} == {v: i for i, v in enumerate(order)}


# 13 ------------------------------------------------------------------------------------------------


def found(text):
    return TERM.findall("" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text))


def ranked(docs, items, k=10):
    tf = [Counter(found(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    all_docs, all_terms = sum(v > 0 for v in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, _), c, size in zip(docs, tf, n):
            m = 25 + (75 * size * all_docs) // all_terms if all_terms else 0
            score = sum(q * math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(found(text)).items() if c[t])
            scores += [(-score, d is None, d or 0, d)] if score else []
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_search_against_brute_force(spark, docs, rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "FIRST_READ", 2)
    many = [(d, t) for d, t, *_ in rows] + [(100 + i, prose(i % 37, 5 + i % 60)) for i in range(400)] + [(900 + i, "copper thing") for i in range(30)]
    table = spark.createDataFrame([(d, t, None, None, None) for d, t in many], SCHEMA).withColumn("ids", F.lit(1)).repartition(4)
    items = [(1, prose(1, 20)), (2, None), (3, ""), (4, "ÜNÏCODE Ünïcode 漢字 don't"), (None, prose(3, 40) + " " + prose(5, 9)), (5, "copper thing"), (5, "copper thing"), (6, "nowhereatall"), (7, prose(8, 2000))]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    folder = build_index(table, str(tmp_path / "index"))
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search(spark, folder, asked).collect())
    assert got == ranked(many, items)
    assert search(spark, folder, asked.limit(0)).collect() == []
    assert search(spark, build_index(empty, str(tmp_path / "none")), asked).collect() == []


def test_sequential_reads_settle_ties_and_scores():
    rng = np.random.default_rng(7)
    for n, terms, top in ((30, 4, 3), (200, 9, 2), (500, 6, 50), (5, 3, 4)):
        gains = rng.integers(0, top, (n, terms))
        lists = []
        for t in range(terms):
            docs = np.flatnonzero(gains[:, t])
            docs = docs[np.lexsort((docs, -gains[docs, t]))]
            lists.append((docs, gains[docs, t].astype(np.int64)))
        ids = rng.permutation(n).astype(np.int64)
        best, scores = no_random_access(lists, n, 10, ids)
        total = gains.sum(axis=1)
        want = sorted((-total[d], ids[d]) for d in range(n) if total[d])[:10]
        assert [(-s, ids[d]) for d, s in zip(best, scores)] == want
