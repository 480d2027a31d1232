"""Operators' own interfaces: packing limits, templates, salvage, ORC pruning, near copies."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphloom.llm import bpe, chat, mtree, packing, repeats, simhash, similar, template, token_orc, warc
from morphloom.llm.queries import vocabulary
from morphloom.storage import fresh_path


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\tab.'é<|>ſ!,…1 　", max_size=60))
def test_cached_ids_are_the_library_s(text):
    encode = bpe.load(vocabulary())
    assert encode(text) == encode.plain(text)


def test_runs_of_punctuation_stay_together():
    encode = bpe.ByteBpe(vocabulary())
    for text in ("wait. wait.. (x) (x), ok! ok!!", "wait.\nwait..\nwait...\nwait?!", "x) x); a. a., he\" he\". don't don't. 7 7. 7.. ² ².", "é é. é.. _ _. 中 中, \u0301 \u0301."):
        assert encode(text) == encode.plain(text)
    rng = random.Random(8)
    for _ in range(300):  # one cache for all of them
        text = " ".join("".join(rng.choice("ab7.,;:!?)('\"é") for _ in range(rng.randint(1, 4))) for _ in range(20))
        assert encode(text) == encode.plain(text), text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_constraint(rule):
    lengths = np.sort(np.random.default_rng(0).integers(1, 60, 400))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 5, 4000), rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 5, 40000))
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_template_language():
    source = "{% set who = 'x' + \"y\" %}{{ who }}{% for t in turns %}{% if t.a == 'k' and not loop.last %}<{{ t.b | up }}>{% elif loop.first or false %}F{% else %}{% generation %}{{ t.b }}{% endgeneration %}{% endif %}{{ loop.index }}{% endfor %}{% if 1 == 2 %}never{% endif %}"
    t = template.Template(source, {"up": str.upper})
    turns = [{"a": "k", "b": "one"}, {"a": "z", "b": "two"}, {"a": "k", "b": None}]
    assert template.render(t, turns=iter(turns)) == "xy<ONE>1" + "two2" + "3"
    assert [s for s in t.compiled()(turns=turns) if s[1]] == [("two", True), ("", True)]
    folded = template.fold(template.parse("a{{ 'b' + 'c' }}{% if true %}d{% endif %}{% if false %}{{ x }}{% endif %}"), {})
    assert folded == (template.Out(template.Const("abcd")),)
    assert template.render(template.Template("{{ 'a' + 1 }}{{ none + 'b' }}{{ 2 + 3 }}{{ x + x }}"), x=4) == "a1b58"
    for bad in ("{% for x %}", "{{ x", "a {% if x", "{{ x.__class__() }}", "{{ x | unknown }}", "{% if a %}", "{{ 'a' }}{% endfor %}", "{{ x[0] }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad, {}).compiled()
    assert template.render(template.Template("{{ x.__class__ }}{{ x.y.z }}"), x="s") == ""


@given(st.text(alphabet="<|\\>imn\nr", max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.many_lines(chat.one_line(text)) == text and "\n" not in chat.one_line(text)


def test_long_conversation_leaves_in_chunks(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x<|y" * 30) for i in range(50)] + [(2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    small = chat.format_conversations(df, chunk_chars=500)
    assert small.where("conv_id = 1").count() > 5
    assert {r.conv_id: r for r in chat.read_back(small).collect()} == whole


def archive(n=5, squeeze=True):
    records = [warc.record(i, f"http://h/{i}\r\nX: y", f"<p>{i}</p>".encode() * (i + 1), None) for i in range(n)]
    return [warc.member(r) if squeeze else r for r in records]


@pytest.mark.parametrize("squeeze", [True, False])
def test_salvage_recovers_what_follows_damage(squeeze):
    parts = archive(squeeze=squeeze)
    whole = b"".join(parts)
    assert [f.reason for f in warc.salvage(whole)] == [None] * 5
    broken = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) - 20
    broken[at : at + 9] = bytes(x ^ 0x55 for x in broken[at : at + 9])
    found = list(warc.salvage(bytes(broken)))
    gaps = [f for f in found if f.headers is None]
    assert [warc._page(f.headers["warc-record-id"]) for f in found if f.headers] == [0, 2, 3, 4]
    assert [(g.offset, g.length) for g in gaps] == [(len(parts[0]), len(parts[1]))] and gaps[0].reason
    cut = list(warc.salvage(b"junk WARC/1.1 no" + whole[: -len(parts[4]) // 2]))
    assert cut[0].reason and cut[-1].reason and sum(f.headers is not None for f in cut) == 4
    assert not list(warc.salvage(b"")) and not list(warc.salvage(b"\0" * 9))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 2000), st.booleans())
def test_salvage_covers_every_byte(noise, at, squeeze):
    whole = b"".join(archive(3, squeeze))
    data = whole[:at] + noise + whole[at:]
    end = 0
    for f in warc.salvage(data):
        assert f.offset >= end or f.headers is not None
        assert not data[end : f.offset].strip(b"\0")
        end = max(end, f.offset + f.length)
    assert not data[end:].strip(b"\0")


def test_records_inside_a_damaged_member_are_saved():
    plain = archive(4, squeeze=False)
    bad = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    whole = warc.member(plain[0] + bad + plain[2] + plain[3])
    found = list(warc.salvage(whole))
    assert [warc._page(f.headers["warc-record-id"]) for f in found if f.headers] == [0, 2, 3]
    assert [f.reason for f in found if f.reason] == [f"inside a member, {len(bad)} bytes at {len(plain[0])}: the block is cut or its length is wrong"]
    noise = random.Random(3).randbytes(200_000)
    long = warc.member(plain[0] + warc.record(9, None, noise, None) + plain[2])
    cut = list(warc.salvage(long[: len(long) - 100_000]))
    assert [warc._page(f.headers["warc-record-id"]) for f in cut if f.headers] == [0] and cut[-1].reason == "gzip: the member is cut"


def test_salvage_time_follows_the_bytes():
    took = []
    for n in (4000, 16000):
        for start in (b"WARC/1.1\r\nA: b\r\n", b"\x1f\x8b\x08junk"):
            began = time.process_time()
            found = list(warc.salvage(start * n + archive(1)[0]))
            took.append(time.process_time() - began)
            assert [bool(f.headers) for f in found] == [False, True]
    assert took[2] < 12 * took[0] + 0.2 and took[3] < 12 * took[1] + 0.2


def test_archives_have_unique_ids_and_bounded_files(spark):
    rows = [(i % 40, f"http://h/{i}", f"<p>{i % 8}</p>" * 50) for i in range(200)] + [(None, None, "<p>1</p>" * 50)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own")).withColumn("kept", F.lit(1))
    path = fresh_path(spark, "warc")
    warc.write_warc(df.repartition(3), path, chunk_bytes=2000)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 3 and max(f.length for f in files) < 9 * 2600
    found = [x for f in files for x in warc.salvage(bytes(f.content))]
    ids = [f.headers["warc-record-id"] for f in found]
    assert len(ids) == len(set(ids)) == len(rows)
    responses = {f.headers["warc-record-id"] for f in found if f.headers["warc-type"] == "response"}
    refers = [f.headers["warc-refers-to"] for f in found if f.headers["warc-type"] == "revisit"]
    assert refers and set(refers) <= responses


def test_gaps_are_reported(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"xx" + b"".join(archive()))
    rows = warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz").collect()
    assert [r.reason for r in rows if r.record_type is None] == ["no version line"] and len(rows) == 6
    assert rows[1].payload == b"<p>0</p>" and rows[1].url.endswith("%0D%0AX:%20y")


def rows_scanned(df):
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numOutputRows").value()


def test_orc_prunes_by_document(spark):
    docs = spark.createDataFrame([(2 * i, f"text {i}") for i in range(12_000)], "doc_id long, text string")
    path = fresh_path(spark, "orc")
    token_orc.write_tokens(docs, path, vocabulary(), 2, files=3)
    one = token_orc.read_tokens(spark, path, [34])
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,34)]" in one._jdf.queryExecution().toString()
    rows, scanned = rows_scanned(one)
    assert np.array(rows[0].ids, "<u4").tobytes() == bpe.load(vocabulary()).plain("text 17") + (2).to_bytes(4, "little")
    assert scanned <= 1000  # one row group of twelve: the others' indexes rule them out
    # odd ids lie between the least and the largest of their row group: only its Bloom filter can tell
    assert sum(rows_scanned(token_orc.read_tokens(spark, path, [2 * i + 1]))[1] for i in (7, 5003, 11_111)) <= 1000


def test_file_count_follows_the_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "doc_id long, text string")
    assert token_orc.file_count(docs) == 1 == token_orc.file_count(docs.limit(0))
    monkeypatch.setattr(token_orc, "LEAST_BYTES", 20_000)
    assert token_orc.file_count(docs) == 5
    monkeypatch.setattr(token_orc, "FILE_BYTES", 7_000)
    assert token_orc.file_count(docs) == 15


def one_each(n):
    return [np.array([i]) for i in range(n)]


def best_of(x, q, k):
    scores = [int(sum(int(a) * int(b) for a, b in zip(v, q))) for v in x]
    return sorted(((s, i) for i, s in enumerate(scores)), key=lambda t: (-t[0], t[1]))[:k]


def test_mtree_is_exact():
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(-300, 300, (3000, 6)), axis=0).astype(float)
    tree, asked = mtree.MTree(mtree.build(x, one_each(len(x)))), x[::200]
    for q, found in zip(asked, tree.search(asked, 5, np.full(len(asked), -1))):
        assert found == best_of(x, q, 5)
    flat = mtree.MTree(mtree.build(np.ones((1, 3)), [np.array([3, 9])]))
    assert flat.search(np.ones((1, 3)), 5, np.array([3])) == [[(3, 9)]]


def test_mtree_skips_what_its_bounds_rule_out():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 800
    x = np.unique(np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 40), axis=0)
    pages = mtree.build(x, one_each(len(x)))
    asked = x[::50]
    for block in (1, 64):
        tree = mtree.MTree(pages)
        found = [f for i in range(0, len(asked), block) for f in tree.search(asked[i : i + block], 5, np.full(len(asked[i : i + block]), -1))]
        assert tree.work["distances"] + tree.work["scores"] < 0.25 * len(asked) * len(x)
        assert block > 1 or len(tree._open) <= len(pages)
        products = asked @ x.T
        for q, best in enumerate(found):
            assert [v for _, v in best] == np.lexsort((np.arange(len(x)), -products[q]))[:5].tolist()
    one = mtree.MTree(pages)
    one.search(asked[:1], 5, np.array([-1]))
    assert len(one._open) < 0.5 * len(pages)  # pages that no bound admits are never decoded


def test_mtree_scores_beyond_doubles():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(-(1 << 28), 1 << 28, (300, 4)), axis=0).astype(float)
    found = mtree.MTree(mtree.build(x, one_each(len(x)))).search(x[:20], 3, np.full(20, -1))
    for q, best in zip(x, found):
        assert best == best_of(x, q, 3)


def test_every_finite_vector_takes_part(spark):
    rows = [(0, [1.5e6, 0.0]), (1, [2e6, 1.0]), (2, [3e7, -1.0]), (3, [0.0, 5.0]), (3, [0.0, 5.0]), (4, [0.25, 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, mtree.top_k(df, df.where("vec_id = 0"), 4).collect()))
    unit = 256 * 1_500_000
    assert got == [(0, 1, 2, unit * 256 * 30_000_000), (0, 2, 1, unit * 256 * 2_000_000), (0, 3, 4, unit * 64), (0, 4, 3, 0)]
    huge = spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        mtree.top_k(huge, huge, 1).collect()


def test_corpus_order_finds_equal_windows():
    rng = random.Random(1)
    for _ in range(40):
        length, letters = rng.choice([20, 30]), rng.choice([b"ab", b"abcdef "])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 3 * length))) for _ in range(3)]
        pieces, trigger, counts = [], [], []
        for _ in range(12):
            text = b""
            for _ in range(rng.randint(1, 4)):
                part, i = rng.choice(base), rng.randrange(length)
                text += part[i : i + rng.randint(1, 2 * length)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            if len(text) >= length:
                for _, _, at, shape in repeats.blocks(text, length, 8):
                    pieces.append(text[at : at + (shape & 255) + length - 1])
                    trigger.append(shape >> 8)
                    counts.append(shape & 255)
        windows = [p[i : i + length] for p, n in zip(pieces, counts) for i in range(n)]
        want = [windows.count(w) > 1 for w in windows]
        assert repeats.repeated_starts(pieces, np.array(trigger), np.array(counts), length).tolist() == want


@pytest.mark.parametrize("most", [4096, 2, 0])
def test_large_groups_are_cut_finer(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "SORTED", most)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(40))
    docs = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + [line[rng.randint(0, 40) : rng.randint(190, 239)]] + [word() for _ in range(rng.randint(0, 30))])) for i in range(60)]
    got = {r.doc_id: r.n_removed for r in repeats.removal_digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    seen = Counter(t[i : i + 200] for _, t in docs for i in range(len(t) - 199))
    for i, t in docs:
        gone = bytearray(len(t))
        for at in range(len(t) - 199):
            if seen[t[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        assert got[i] == sum(gone)


def test_segments_do_not_change_repeats(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdef ") for _ in range(3000))
    starts = lambda rows: sorted((at + i) for _, _, at, shape in rows for i in range(shape & 255))
    whole = list(repeats.blocks(data, 200, 96))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = list(repeats.blocks(data, 200, 96))
    assert starts(whole) == starts(parts) == list(range(2801))
    assert {(c, at) for c, _, at, _ in whole} >= {(c, at) for c, _, at, _ in parts if (c, at) in {(c, at) for c, _, at, _ in whole}}
    assert zlib.crc32(repeats.kept_bytes(data, [(0, 10), (20, 3000)])) == zlib.crc32(data[10:20])


@pytest.mark.parametrize("page", [512, 40])
def test_similar_groups_against_brute_force(spark, page):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, None), (901, ""), (902, "one"), (903, "one"), (None, docs[0][1]), (904, docs[0][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in similar.similar_groups(df, page=page).collect()}
    own = [(i, set(similar.shingles(t).tolist())) for i, t in docs if i is not None]
    root = {i: i for i, _ in own}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, (i, x) in enumerate(own):
        for j, y in own[:a]:
            if x == y or (x and len(x & y) >= 0.8 * len(x | y)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, _ in own:
        groups.setdefault(find(i), []).append(i)
    want = {i: min(v) for v in groups.values() if len(v) > 1 for i in v}
    assert got == want
    assert similar.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [4096, 16, 3])
def test_links_do_not_depend_on_pages(spark, page):
    rng = random.Random(page)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for v in values for _ in range(rng.choice([0, 0, 1, 3]))]
    # a family that shares most bits, so that some shards are cut again
    values += [values[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(120)]
    signed = np.array(sorted(set(values)), np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), page=page).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in links)
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert groups_of({(min(r.a, r.b), max(r.a, r.b)) for r in links}) == groups_of(near)


def similar_pairs(docs):
    own = [(i, set(similar.shingles(t).tolist())) for i, t in docs]
    return {(min(i, j), max(i, j)) for a, (i, x) in enumerate(own) for j, y in own[:a] if len(x & y) >= 0.8 * len(x | y)}


def groups_of(pairs):
    root = {i: i for p in pairs for i in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def variants(n, words, share, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    return [" ".join(word() if rng.random() < share else w for w in base) for _ in range(n)]


def test_every_pair_of_a_large_shard_meets(spark):
    docs = list(enumerate(variants(40, 300, 0.01, 2)))
    nodes = similar._sketches(spark.createDataFrame(docs, "doc_id long, text string"))
    met = {}
    for r in similar._units(nodes.withColumn("group", nodes.doc_id), 0.8, 4).collect():
        met.setdefault(r["unit"], set()).add(r["same"])
    name = {r.doc_id: r.same for r in nodes.collect()}
    pairs = similar_pairs(docs)
    assert len(pairs) > 300 and max(map(len, met.values())) < 24
    assert all(any(name[i] in u and name[j] in u for u in met.values()) for i, j in pairs)


def test_false_likely_pairs_hide_no_true_ones(spark):
    texts = variants(150, 400, 0.021, 5)
    docs = list(enumerate(texts))
    want = groups_of(similar_pairs(docs))
    assert 20 < len(docs) - len(want) + len(set(want.values())) < 120  # many components of likely pairs
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.group_id for r in similar.similar_groups(df).collect()} == want


def test_links_through_any_member(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    last = list(base)
    last[120:136] = [word() for _ in range(16)]
    docs = [(1, " ".join(word() for _ in range(200))), (2, " ".join(base)), (3, " ".join(last)), (4, " ".join(word() for _ in range(200)))]
    assert similar_pairs(docs) == {(2, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    # let 1 and 2 be linked by their fingerprints: 3 is near to 2 alone
    fps = {i: np.array(simhash.fingerprint(t), np.uint64).view(np.int64).item() for i, t in docs}
    known = spark.createDataFrame([(i, fps[i], 1 if i < 3 else i) for i, _ in docs], "doc_id long, fp long, component_id long")
    monkeypatch.setattr(simhash, "near_components", lambda docs: known)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {1, 4}


def test_rows_without_an_id_of_their_own(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    docs = [(1, a, "x"), (1, b, "x"), (1, a + " more", "x"), (2, c, "x"), (None, c, "x"), (None, d, "x"), (None, d.upper(), "x"), (5, d + " end", "x"), (7, b, "x"), (7, b, "x"), (9, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, group string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    kept = sorted((r.text or "").lower()[:20] for r in got)
    assert kept == sorted(t[:20] for t in (a, b, c, d, ""))
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in docs} and {r.doc_id for r in got if r.text and r.text.lower()[:9] in (c[:9], d[:9])} == {2, 5}
    own = df.where("doc_id = 2 OR doc_id = 5")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, own, "").collect()) == [2, 5]
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_every_stage_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_language_stage_tells_the_language(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = corpus_pipeline.identify_language(spark, hidden, "").join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert got.where("lang IS NULL").count() == 0 and got.agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0] > 0.95
