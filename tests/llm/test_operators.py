"""Each operator against brute force on small tables, awkward rows included."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from awkward import SCHEMA, prose

from tidemark.llm.bpe import encode_and_decode, load_encoding
from tidemark.llm.chat import chat_documents
from tidemark.llm.components import components
from tidemark.llm.fingerprints import Powers, PrefixHashes, edited_fingerprints, fingerprint, likeness
from tidemark.llm.langid import keep_identified, predict_languages, viterbi
from tidemark.llm.near_dedup import keep_one_of_each, near_duplicates
from tidemark.llm.packing import crossover, decreasing, evolve, exact_fill, pack_documents
from tidemark.llm.quality import keep_quality, quality_rules
from tidemark.llm.secret_scan import candidates, redact, scan_secrets, without_secrets
from tidemark.llm.token_files import bits_for, pack_bits, read_token_files, unpack_bits, write_token_files
from tidemark.llm.tokens import PieceEncoder
from tidemark.llm.url_filter import judge_urls

BYTES_JSON, WORDS_JSON = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
AWKWARD = ["", " ", "  two  blanks ", "a\n\n b", "x \n y", "tab\t\tx", "don't we'll", " lead", "trail ", "\xa0nb sp\u3000x", "e\u0301 é", "ΣΑΣ ΟΔΟΣ", "1 22 333", "!?! ...", "漢字 かな", "a\x1cb c\x85d", "<|endoftext|> x", "🎉🎉 ok", "a  \n  b   c", "dogs' it's' x'sy rock'n'roll, ''", "word,\nNext. (par) end...\n\nlast\n", "ÀÉÎ Straße İstanbul ǅ ŉ KK ﬁn ẞ", "one\n two \nthree", "$5,000.00! no-one_x", "a\n\tb c\n"]


def plain(text):
    return text or ""


# 1 -------------------------------------------------------------------------------------------------


def test_prefix_hashes_answer_spans_and_extensions():
    powers = Powers()
    one, two = prose(1, 60), prose(1, 30) + "#" + prose(2, 30)
    a, b = PrefixHashes.of(one, powers), PrefixHashes.of(two, powers)
    for i, j, n in ((0, 0, 9), (3, 5, 4), (10, 10, 50)):
        assert (a.span(i, i + n) == b.span(j, j + n)) == (one[i : i + n] == two[j : j + n])
    for i, j in ((0, 0), (4, 4), (2, 9), (len(one), 0)):
        n = 0
        while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
            n += 1
        assert a.common(i, b, j) == n
    assert fingerprint(a.joined(20, b, 15)) == fingerprint(PrefixHashes.of(one[:20] + two[:15], powers))


def test_likeness():
    powers = Powers()
    mark = lambda t: fingerprint(PrefixHashes.of(t, powers))
    text = prose(5, 200)
    assert likeness(mark(text), mark(text)) == 1 and likeness(mark(""), mark("")) == 1 and likeness(mark(""), mark("a")) == 0
    assert likeness(mark(text), mark(text[:600] + "X" + text[601:])) > 0.7
    assert likeness(mark(text), mark(prose(6, 200))) < 0.05
    assert 0.4 < likeness(mark(text), mark(text[: len(text) // 2])) < 0.6


def test_likeness_against_true_extensions():
    """Common prefix and suffix by comparing characters, over texts that repeat themselves, edited ones and unrelated ones."""
    powers, rnd = Powers(), np.random.default_rng(31)
    draw = lambda n, letters: "".join(rnd.choice(list(letters), n))
    pairs = [("ab " * 1000, "ab " * 1500), ("", ""), ("", "a"), ("a" * 50, "a" * 49)]
    for _ in range(200):
        one = draw(int(rnd.integers(0, 300)), "ab" if rnd.random() < 0.3 else "abcdefgh")
        at = int(rnd.integers(0, len(one) + 1))
        pairs += [(one, one[:at] + draw(int(rnd.integers(0, 40)), "xyz") + one[at:]), (one, one[at:]), (one, draw(50, "abc"))]
    for one, two in pairs:
        ends = [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))) for x, y in ((one, two), (one[::-1], two[::-1]))]
        shared, longest = min(sum(ends), len(one), len(two)), max(len(one), len(two))
        got = likeness(*(fingerprint(PrefixHashes.of(t, powers)) for t in (one, two)))
        want = 1.0 if one == two else shared / longest
        assert got == likeness(*(fingerprint(PrefixHashes.of(t, powers)) for t in (two, one)))
        assert 0.8 * want <= got <= want + 1e-12


def test_op1_against_brute_force(docs, rows, clashing, empty):
    order = sorted(((d, plain(t)) for d, t, *_ in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = Counter()
    for i, (d, t) in enumerate(order):
        following, half = order[(i + 1) % len(order)][1], len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    for table in (docs, docs.repartition(5), clashing):
        got = edited_fingerprints(table).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        same = defaultdict(set)
        for r in got:
            same[r.fingerprint].add(r.n_chars)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert all(len(v) == 1 for v in same.values())
    assert edited_fingerprints(empty).collect() == []
    assert len(edited_fingerprints(docs.limit(1)).collect()) == 1


# 2 and 7: tokens -----------------------------------------------------------------------------------


@pytest.mark.parametrize("path, glue", [(BYTES_JSON, " "), (WORDS_JSON, "")])
def test_pieces_encode_as_whole_texts(path, glue):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = AWKWARD + [" ".join(AWKWARD), "".join(AWKWARD), prose(9, 300)]
    for batch in (texts, texts[::-1], texts[5:9], [""], ["a b"], []):
        ids, bounds = PieceEncoder(path, glue, most=50).encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in whole.encode_batch(batch, add_special_tokens=False)]


def test_evolution_reaches_the_bound():
    rng = np.random.default_rng(3)
    cuts = [np.diff(np.sort(np.concatenate(([0, 100], rng.choice(np.arange(1, 100), 3, replace=False))))) for _ in range(200)]
    sizes = np.concatenate(cuts)
    rng.shuffle(sizes)
    bins = evolve(sizes, None, None, 100, 1, generations=30)
    assert np.bincount(bins, weights=sizes).max() <= 100 and len(np.unique(bins)) <= 201


def test_packings_hold_every_item_once():
    rng = np.random.default_rng(4)
    for n, top in ((1, 10), (2, 64), (300, 64), (500, 20), (400, 64)):
        sizes = rng.integers(1, top + 1, n)
        one, two = exact_fill(sizes, 64), decreasing(sizes, 64, 30.0, rng)
        child = crossover(one, two, sizes, 64, rng)
        for packing in (one, two, child, crossover(two, child, sizes, 64, rng)):
            assert len(packing.bin_of) == n and packing.fills.max() <= 64
            assert np.bincount(packing.bin_of, weights=sizes).tolist() == packing.fills.tolist()
            assert len(packing.fills) <= 1.3 * -(-sizes.sum() // 64) + 1


def check_packing(got, texts_by_id, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES_JSON)
    whole.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for d, texts in texts_by_id.items():
        want = Counter()
        for t in texts:
            ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
            first = (len(ids) - 1) % capacity + 1
            for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                part = ids[at : (at + capacity) if k else first]
                want[k, at, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d]) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_op2_packing(docs, rows, clashing, empty, capacity):
    by_id = defaultdict(list)
    for d, t, *_ in rows:
        by_id[d].append(plain(t))
    for table in (docs, clashing):
        got = pack_documents(table, BYTES_JSON, capacity=capacity).collect()
        count = check_packing(got, by_id, capacity)
        assert count <= -(-sum(r.length for r in got) // capacity) + 1
    assert pack_documents(empty, BYTES_JSON).collect() == []


def test_bits_round_trip():
    rng = np.random.default_rng(1)
    for vocabulary in (2, 3, 1000, 49_408, 65_536, 200_000, 1 << 31):
        bits = bits_for(vocabulary)
        ids = rng.integers(0, vocabulary, 777).astype(np.uint32)
        packed = pack_bits(ids, bits)
        assert len(packed) == -(-777 * bits // 8)
        for begin, count in ((0, 777), (5, 1), (776, 1), (100, 333), (3, 0)):
            assert unpack_bits(packed, bits, begin, count).tolist() == ids[begin : begin + count].tolist()


def test_op7_files(spark, docs, rows, clashing, empty, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS_JSON)
    whole.encode_special_tokens = True
    want, at = Counter(), 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], plain(r[1]))):
        ids = np.array(whole.encode(plain(t), add_special_tokens=False).ids + [1], dtype="<u4")
        want[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    for i, table in enumerate((docs, docs.repartition(4), clashing)):
        folder = write_token_files(table, f"{tmp_path}/f{i}", WORDS_JSON, 49_408)
        assert Counter(tuple(r) for r in read_token_files(spark, folder).collect()) == want
    assert read_token_files(spark, write_token_files(empty, f"{tmp_path}/none", WORDS_JSON, 49_408)).collect() == []


# 3 -------------------------------------------------------------------------------------------------


def test_op3_urls(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de", "ftp://sub.example.com/de/1#f", "http://example.com/de", "http://x.org/fr/", "no scheme", "", None, "http://", "http://net/", "a://b://c/d", "HTTP://WWW.Bad.com/p/?utm_x=1&b=2&a=1", "https://bad.com/p?a=1&b=2#z", "https://bad.com/p?a=1", "http://notexample.net", "http://É.com/x\ny"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(0, urls[0], "h", "k")], "page_id long, url string, html string, block string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    listed = spark.createDataFrame([("http://bad.com/p?b=2&a=1",), (None,), ("http://bad.com/p?b=2&a=1",), ("nothing",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, listed).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "block" if i in (11, 12) else "allow"), u
    none = pages.limit(0)
    assert judge_urls(none, rules, listed).collect() == []
    assert all(r.verdict == "allow" for r in judge_urls(pages, [], none).collect())
    many = spark.range(3000).selectExpr("concat('http://h', id, '.com/x') AS url", "id AS page_id")
    flagged = judge_urls(many, [], many.where("page_id % 3 = 0")).where("verdict = 'block'").collect()
    assert sorted(r.page_id for r in flagged) == list(range(0, 3000, 3))


# 4 -------------------------------------------------------------------------------------------------


def test_op4_snapshots(spark):
    said = [("user", "hi"), ("assistant", "yo"), ("user", None), (None, "end")]
    rows = [(c, t, *said[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"), (6, 0, None, "hi"), (7, None, "user", "x"), (None, 0, "user", "solo"), (8, 0, "user", ""), (9, 0, "user", None)]
    rows += [(10, t, "user", f"t{t}") for t in range(2500)] + [(11, t, "user", f"t{t}") for t in range(1500)]
    table = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = chat_documents(table).collect()
    assert {r.conv_id for r in got} == {2, 5, 6, 7, None, 8, 9, 10} and [r.rendered for r in got if r.conv_id is None] == ["<|user|>\nsolo<|end|>\n"]
    by = {(r.conv_id, r.segment): r for r in got}
    assert by[2, 0].copies == 2 and by[2, 0].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\n<|end|>\n<||>\nend<|end|>\n"
    assert by[5, 0].n_turns == 2 and [by[10, s].n_turns for s in range(3)] == [1024, 1024, 452]
    assert "".join(by[10, s].rendered for s in range(3)) == "".join(f"<|user|>\nt{t}<|end|>\n" for t in range(2500))
    assert chat_documents(table.limit(0)).collect() == []


def test_op4_without_ids_and_in_one_turn(spark):
    """Rows without an id are conversations of their own, a null turn is no number, a turn of any length is cut into segments."""
    rows = [(None, 0, "user", "log one")] * 3 + [(None, 1, "user", "log two"), (None, 0, "user", "hi"), (None, 0, "user", "x"), (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "x")]
    rows += [(3, None, "user", "t"), (4, -1, "user", "t"), (None, None, "user", "t"), (-(1 << 63), 0, "user", "low"), (5, None, "user", "a"), (5, 0, "user", "b"), (6, None, "user", "a")]
    rows += [(7, 3, "user", f"m{i:05d}") for i in range(3000)] + [(7, 4, "bot", "end")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    for shuffled in (table, table.repartition(7)):
        got = {(r.conv_id, r.segment, r.rendered if r.conv_id is None else ""): r for r in chat_documents(shuffled).collect()}
        assert {(k[0], k[2]): r.copies for k, r in got.items() if k[0] is None} == {(None, said("user", "log one")): 3, (None, said("user", "log two")): 1}
        assert got[1, 0, ""].copies == 1 and got[2, 0, ""].copies == 2 and got[3, 0, ""].copies == 2 and got[4, 0, ""].copies == 1 and (6, 0, "") not in got
        assert got[5, 0, ""].rendered == said("user", "a") + said("user", "b") and got[-(1 << 63), 0, ""].rendered == said("user", "low")
        assert "".join(got[7, s, ""].rendered for s in range(3)) == "".join(said("user", f"m{i:05d}") for i in range(3000)) + said("bot", "end")
        assert [got[7, s, ""].n_turns for s in range(3)] == [1, 1, 2] and len(got) == 2 + 6 + 3


# 5 -------------------------------------------------------------------------------------------------


def test_viterbi_against_brute_force():
    from itertools import product

    from tidemark.llm.langid import SWITCH_PENALTY

    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 30, (9, 3))
    label = viterbi(scores, counts)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - SWITCH_PENALTY * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        if n:
            assert value(label[at : at + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))
        at += n


def languages(spark):
    sets = {"en": "the and of to with that house water from have".split(), "de": "der und nicht über haus wasser schön große ist ein".split(), "ru": "дом вода река и на что это большой город".split()}
    rows = [(i, " ".join(sets[lang][(i * 7 + k * 3) % len(sets[lang])] for k in range(40)), lang, None, None) for i, lang in enumerate(["en", "de", "ru"] * 20)]
    mixed = rows[0][1] + " " + rows[2][1] + " " + rows[2][1]
    odd = [(1000, mixed, None, None, None), (1001, None, "en", None, None), (1002, "12 !?", "en", None, None), (None, rows[1][1], "en", None, None), (1003, "", None, None, None)]
    return spark.createDataFrame(rows + odd, SCHEMA)


def test_op5_languages(spark, clashing, empty):
    table = languages(spark)
    got = {r.doc_id: r for r in predict_languages(table).collect()}
    for r in table.collect():
        if r.doc_id is not None and r.doc_id < 1000:
            assert got[r.doc_id].lang_pred == r.lang and got[r.doc_id].score == 1
            assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert [(s.lang, s.first_word, s.words) for s in got[1000].spans] == [("en", 0, 40), ("ru", 40, 80)]
    assert got[1000].lang_pred == "ru" and 0.5 < got[1000].score < 1
    assert [(got[k].lang_pred, got[k].score, got[k].spans) for k in (1001, 1002, 1003)] == [("und", 0, [])] * 3
    assert got[None].lang_pred == "de" and got[None].held_out
    assert predict_languages(empty).collect() == [] and keep_identified(empty).collect() == []
    assert predict_languages(clashing).count() == clashing.count()
    assert keep_identified(clashing).columns == clashing.columns
    kept = {r.doc_id for r in keep_identified(table).collect()}
    assert kept == {r.doc_id for r in table.collect()} - {1001, 1002, 1003}
    unlabelled = table.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in predict_languages(unlabelled).collect()} == {"und"} and keep_identified(unlabelled).count() == 62


# 6 -------------------------------------------------------------------------------------------------


def test_op6_secrets(spark, docs, clashing, empty):
    def digest(i):
        return hashlib.sha1(str(i).encode()).hexdigest()

    rows = [(i, f'{prose(i, 20)} token = "{digest(i)}" {prose(i + 1, 5)} 49529352{i:08d} mail.{i}@host{i % 9}.example.com', "en", None, None) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (None, f'x password: "{digest(999)}" y', None, None, None), (102, f'Key {"q" * 5000} token = "{digest(7)}", token = "{digest(8)}"', None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = scan_secrets(table)
    got = {(r.doc_id, r.value): r.is_secret for r in found.collect()}
    for i in range(60):
        assert got[i, digest(i)] and not got[i, f"49529352{i:08d}"] and not got[i, f"mail.{i}@host{i % 9}.example.com"]
    assert got[102, digest(7)] and got[102, digest(8)] and got[None, digest(999)]
    clean = {r.doc_id: r.text for r in redact(table, found).collect()}
    assert len(clean) == len(rows) and clean[100] is None and clean[101] == ""
    assert clean[3] == rows[3][1].replace(digest(3), "[SECRET]") and clean[102].count("[SECRET]") == 2
    labelled = scan_secrets(table.where("doc_id < 60"))  # no finding is labelled a secret: none is reported
    assert labelled.count() == 180
    assert scan_secrets(empty).collect() == [] and scan_secrets(docs).collect() == []
    assert redact(clashing, scan_secrets(clashing)).columns == clashing.columns


def test_op6_every_run_of_a_word_is_a_candidate(spark):
    """Runs after the first of a word, runs without a digit, and short values that a key names."""
    rows = [('AWS_SECRET_ACCESS_KEY="wJalrXUtnFEMI/K7MDENG1"', {"wJalrXUtnFEMI/K7MDENG1"}), ('{"access_token":"ghp_16C7e42F292c6912E7710c83","password":"hunter2"}', {"ghp_16C7e42F292c6912E7710c83", "hunter2"}), ("password: s3cr!t#9 x", {"s3cr!t#9"}), ("漢字token=abcd1234efgh5678漢字,k=zyxw9876zyxw5432漢字", {"abcd1234efgh5678", "zyxw9876zyxw5432"}), ("x onlyLettersInThisKey y", {"onlyLettersInThisKey"}), ("https://bob:pa55word@host.example.com/p?api_key=abc123def&x=1", {"pa55word", "abc123def"})]
    found = candidates(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    for i, (_, want) in enumerate(rows):
        assert want <= {r.value for r in found if r.doc_id == i}
    assert len({(r.doc_id, r.word_no, r.run_no) for r in found}) == len(found)
    assert [(r.left, r.quoted) for r in found if r.value == "hunter2"] == [('","password":"', True)]


def test_op6_several_secret_formats_and_lookalikes(spark):
    """Secrets of other forms than the tables' own are found and redacted, hashes and names stay, a long text is split once."""
    import time

    hexes = [hashlib.sha1(f"h{i}".encode()).hexdigest() for i in range(4)]
    secrets = [(f'token="{hexes[0]}"', hexes[0]), (f"token: {hexes[1]}", hexes[1]), ("DB_PASSWORD=Zk93jfLq02mx", "Zk93jfLq02mx"), ('{"id":1,"password":"hunter2"}', "hunter2"), ("Authorization: Bearer abcDEF123456ghiJKL789xx", "abcDEF123456ghiJKL789xx"), ("https://api.example.com/p?api_key=abc123def&x=1", "abc123def")]
    others = [f"commit {hexes[2]} by x", f"sha256: {hexes[3]}", '"some_longer_name": 5', "file: src/main/java/com/example/Foo.java", "550e8400-e29b-41d4-a716-446655440000"]
    texts = [f"{prose(i, 30)} {t} {prose(i + 1, 5)}" for i, (t, _) in enumerate(secrets)] + [f"{prose(i, 30)} {t} {prose(i + 1, 5)}" for i, t in enumerate(others)] + [prose(3, 20_000) + " token = "]
    table = spark.createDataFrame([(i, t, None, f"a/{i}.yaml", None) for i, t in enumerate(texts)], SCHEMA)
    begun = time.monotonic()
    found = scan_secrets(table)
    clean = {r.doc_id: r.text for r in redact(table, found).collect()}
    assert time.monotonic() - begun < 90
    assert [clean[i] for i in range(len(texts))] == [t.replace(secrets[i][1], "[SECRET]") if i < len(secrets) else t for i, t in enumerate(texts)]


# 8 -------------------------------------------------------------------------------------------------


def test_op8_chunks(spark, docs, rows, clashing, empty):
    encoding = load_encoding(RANKS, public_tokenizers.PATTERN)
    texts = [plain(r[1]) for r in rows] + AWKWARD + ["".join(AWKWARD) * 9, " ".join(AWKWARD) * 9, "a" * 900, "a" * 100 + " b" * 300 + "c" * 300 + " d" * 100, "\n" * 700, "x'" * 300, "'re" * 200 + " x", prose(4, 400)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (500, None)], "doc_id long, text string")
    for sizes in ({"chunk": 64, "overlap": 32, "margin": 8}, {"chunk": 200, "overlap": 40, "margin": 10}, {}):
        got = encode_and_decode(table, RANKS, public_tokenizers.PATTERN, **sizes).collect()
        assert len(got) == len(texts) + 3
        for r in got:
            t = texts[r.doc_id or 0] if r.doc_id != 500 else ""
            ids = encoding.encode_ordinary(t)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), (sizes, t[:60])
    assert encode_and_decode(empty, RANKS, public_tokenizers.PATTERN).collect() == []
    assert encode_and_decode(clashing, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=50, margin=10).count() == clashing.count()


# 9 -------------------------------------------------------------------------------------------------


def brute_components(rows, percent):
    sets = []
    for _, t, *_ in rows:
        words = plain(t).encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)] += [r[0]] if r[0] is not None else []
    return sets, [min(least[find(i)], default=None) for i in range(len(rows))]


def edited(seed, n_words, edits):
    words = prose(seed, n_words).split()
    for e in edits:
        words[e % n_words] = f"edit{e}"
    return " ".join(words)


def test_op9_components(spark, rows, docs, clashing, empty):
    made = [(100 + i, edited(50, 150, [7 * i % 150, 11 * i % 150][: 1 + i % 2]), None, None, None) for i in range(60)]  # a crowd round one text
    made += [(300 + i, edited(51, 160, range(0, 2 * i, 2)), None, None, None) for i in range(25)]  # a chain: neighbours alike, ends not
    made += [(400 + i, prose(60 + i, 50), None, None, None) for i in range(20)] + [(500, prose(60, 50).upper(), None, None, None), (501, "Alpha  BETA", None, None, None), (502, "alpha\tbeta\n", None, None, None), (499, made[0][1], None, None, None)]
    every = list(rows) + made
    table = spark.createDataFrame(every, SCHEMA)
    sets, component = brute_components(every, 85)
    want = Counter((r[0], len(s), c if s else r[0], r[0] == (c if s else r[0])) for r, s, c in zip(every, sets, component))
    got = near_duplicates(table).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert near_duplicates(empty).collect() == [] and near_duplicates(clashing).count() == clashing.count()
    kept = keep_one_of_each(table, percent=80, bands=30, rows=5)
    _, component = brute_components(every, 80)
    expected = {(r[0], r[1]) for r, s, c in zip(every, sets, component) if not s or r[0] == c or c is None}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected)
    assert keep_one_of_each(clashing).columns == clashing.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (300, 100), (7, 7), (500, 501), (501, 500)] + [(1000, 1001 + i) for i in range(50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 500: 500, 501: 500, **{1000 + i: 1000 for i in range(51)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_op9_rows_without_ids(spark):
    """A third of the rows has no id: they link like all others, and one row of each group stays."""
    base, other = prose(31, 200), prose(32, 150)
    near = lambda t, k: " ".join([*t.split()[:-1], f"end{k}"])
    rows = [(1, base), (2, prose(33, 90)), (None, near(base, 1)), (None, near(base, 1)), (None, other), (None, near(other, 2)), (None, near(other, 3)), (7, "a b"), (None, "a b"), (None, None), (None, None), (8, None), ((1 << 63) - 1, prose(34, 80)), (None, near(prose(34, 80), 1))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda t: (t or "").split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    got = near_duplicates(table).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, smallest[group[i]]) for i, (d, _) in enumerate(rows))
    kept = keep_one_of_each(table).collect()
    assert {r.doc_id for r in kept} == {1, 2, 7, 8, (1 << 63) - 1, None} and len(kept) == 7
    assert sorted(r.text is not None and r.text.startswith(other[:100]) for r in kept if r.doc_id is None) == [False, True]


def test_op6_redacts_rows_without_ids(spark):
    secret = "ghp_" + hashlib.sha256(b"x").hexdigest()[:36]
    rows = [(1, f'token = "{secret}" here', "a"), (None, f'token = "{secret}" here', "a"), (None, f"and password: {secret} too", "a"), (None, None, "a"), (None, "", "a"), (2, prose(3, 40), "a")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = without_secrets(table).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter((d, t and t.replace(secret, "[SECRET]")) for d, t, _ in rows)


# 10 ------------------------------------------------------------------------------------------------


def test_op10_against_brute_force(spark, docs, rows, clashing, empty):
    import os

    noise = base64.b64encode(os.urandom(6000)).decode()
    more = [(600, "same line here\n" * 40, None, None, None), (601, " ".join(noise[i : i + 60] for i in range(0, len(noise), 60)), None, None, None), (602, prose(3, 40) + "\n \n" + prose(3, 40) + "\n#$|", None, None, None), (603, ("ab" * 300 + " ") * 30, None, None, None), (604, "\n".join(f"line {i % 3} x" for i in range(30)), None, None, None)]
    every = list(rows) + more
    table = spark.createDataFrame(every, SCHEMA)
    want = Counter()
    for d, t, *_ in every:
        t = plain(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        want[d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)] += 1
    got = quality_rules(table).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[2] and kept[8] and not any(kept[k] for k in (4, 5, 6, 7, 600, 601, 603))
    assert quality_rules(empty).collect() == [] and keep_quality(clashing).columns == clashing.columns
    assert keep_quality(table).count() == sum(r.kept for r in got)


def test_op10_noise_inside_a_text_is_dropped(spark):
    """Base64 in a fifth of a text or more, and of 3 KB at least, at either end or inside; texts without it stay."""
    rng, rows, noisy = np.random.default_rng(23), [], set()
    # words of two syllables and a running number: no phrase repeats
    part = ["".join(p) for p in zip(rng.choice(list("bdfgklmnprst"), 400), rng.choice(list("aeiou"), 400), rng.choice(list("lmnrst"), 400))]
    say = lambda n: " ".join(part[a] + (part[b] if b % 3 else "") for a, b in rng.integers(0, 60, (n // 3, 2)).tolist())[:n]
    for length in (3000, 10_000, 20_000, 60_000):
        rows.append((len(rows), say(length), None, None, None))
        for share in (0.2, 0.3, 0.5):
            cut = int(length * share)
            if cut < 3 * 1024:  # two small chunks at least lie wholly in the noise
                continue
            for place in (0.0, 0.4, 1.0):
                raw = base64.b64encode(rng.bytes(cut)).decode()
                noise = " ".join(raw[i : i + 76] for i in range(0, len(raw), 76))[:cut]
                clean = say(length - cut)
                at = int(len(clean) * place)
                noisy.add(len(rows))
                rows.append((len(rows), clean[:at] + " " + noise + " " + clean[at:], None, None, None))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, r in got.items() if not r.kept} == noisy and noisy


def test_op10_noise_of_each_length_is_dropped(spark):
    rng = np.random.default_rng(5)
    noise = base64.b64encode(rng.bytes(40_000)).decode()
    words = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    sizes = (300, 500, 700, 900, 1200, 1500, 2500, 4000, 6000, 12_000, 30_000)
    rows = [(i, words[:n], None, None, None) for i, n in enumerate(sizes)] + [(100 + i, "ä" + prose(i, n // 8), None, None, None) for i, n in enumerate(sizes)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in range(len(sizes)))
    assert all(got[100 + i].kept for i in range(len(sizes)))


def test_encoders_of_earlier_stages_are_dropped():
    """Language identification holds no encoder that packing left in the same Python worker."""
    import weakref

    from tidemark.llm.langid import drop_encoders
    from tidemark.llm.tokens import encoder_of

    left = weakref.ref(encoder_of(BYTES_JSON, " "))
    assert left() is not None and encoder_of.cache_info().currsize == 1
    drop_encoders()
    assert left() is None and encoder_of.cache_info().currsize == 0
