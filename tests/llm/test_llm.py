"""Operators against brute force, libraries, round trips and held-out accuracy, on small fixtures."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rubrica.llm import embeddings, html, language, licenses, mixing, mpeg, pieces, repair, sharding, shared, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same text here", "en", "a", 14), (3, "same text here", "en", "a", 14), (4, "same text here", "fr", "b", 14), (None, "no id", "en", "a", 5), (5, "word " * 5000, "en", "a", 25000), (6, "  two  spaces ▁ mark\n\ttab é 日本🎉\x00", "en", "b", 10)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def save(df, path, name="documents"):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in shared.components(e).collect()} == {2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 21: 20} or {r["node"] for r in shared.components(e).where("root = 1").collect()} >= {2, 3, 7, 8, 9}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in shared.components(chain).collect()} == {0}
    assert shared.components(e.where("false")).count() == 0


# op 1

def test_sharding(spark, tmp_path):
    got = sharding.op1_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        raw = (docs.text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_odd_rows(spark, odd, empty, tmp_path):
    got = sharding.op1_sharding(spark, save(odd, tmp_path / "a"))
    assert got.count() == len(ODD) and got.where("doc_id = 1").first()["size"] == 8
    assert sharding.op1_sharding(spark, save(empty, tmp_path / "b")).count() == 0


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=200), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_rebalancing(sizes, shards):
    found = {i: (s, 1) for i, s in enumerate(sizes)}
    first = sharding.initial(len(sizes), shards)
    out = sharding.rebalanced(first, found, shards)
    load = lambda m: [sum(s for i, (s, _) in found.items() if m[i] == k) for k in range(shards)]
    assert len(out) == len(sizes) and sum(load(out)) == sum(sizes) and max(load(out)) - min(load(out)) <= max(load(first)) - min(load(first))
    assert max(load(out)) - min(load(out)) <= max(sizes)
    grown = sharding.rebalanced(out, found, shards + 1)
    assert set(grown) <= set(range(shards + 1))


# op 2

def test_html_cases():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; line</h1><p>First<br>para\n graph, with a stop.<p><b>Second one.</article><aside><p>Side text, long enough to look like content.</p></aside><div id='comments'><p>I liked this very much, thank you.</p></div><footer>&copy; x</footer>"
    assert html.main_text(page) == "Head & line First para graph, with a stop. Second one."
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<script>x</script><!-- y") == ""
    body = "<body>" + "".join(f"<p>{'plain words of a paragraph ' * 6}number {i}.</p>" for i in range(30)) + "</body>"
    assert html.main_text(body).count("number") == 30
    assert len(html.main_text("<article>" + "<p>word</p>" * 20000)) == 20000 * 5 - 1


def test_html_open_head_and_hidden_attributes():
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><script>x</script><style>y</style>", "<head><title>T</title></head>", "<head><template><p>no</p></template>"):
        for body in ("<body><article><p>One text.</p></article>", "<article><p>One text.</p></article>", "<main>One text.</main>"):
            assert html.main_text(f"<html>{head}{body}") == "One text."
    assert html.main_text("<head><title>T</title>One text, and the rest of the article <b>here</b>.<article><p>More.</p></article>").endswith("More.")
    for shown in ('title="the hidden cost"', "title='a hidden gem'", 'data-x="display:none"', "alt=hidden", 'style="color:red; --x: display"', 'class="hidden-part"'):
        assert html.main_text(f"<article><section {shown}><p>One text.</p></section></article>") == "One text."
    for gone in ("hidden", "id=x hidden", 'HIDDEN=""', "hidden='until-found'", 'style="color:red;display : none"', "style=display:none", "style='display:none!important'"):
        assert html.main_text(f"<article><section {gone}><p>No text.</p></section><p>One text.</p></article>") == "One text."


@given(st.lists(st.integers(-20, 20), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 9)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_minimum_cut(z, raw):
    edges = {}
    for a, b, c in raw:
        if a != b and max(a, b) < len(z):
            edges[a, b] = edges.get((a, b), 0) + c
    cost = lambda keep: sum(-x if x < 0 else 0 for x, k in zip(z, keep) if k) + sum(x if x > 0 else 0 for x, k in zip(z, keep) if not k) + sum(c for (a, b), c in edges.items() if keep[a] != keep[b])
    best = min(cost([m >> i & 1 == 1 for i in range(len(z))]) for m in range(1 << len(z)))
    assert cost(html.cut(z, edges)) == best


@given(st.text(alphabet="<>/=\"' abpdivliscript!-&;", max_size=80))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(text):
    assert isinstance(html.main_text(text), str)


def test_html_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "<p>First one, a paragraph with a stop.</p>", "a", "b", 9, "c")], "page_id int, html string, _html string, __html string, n_chars int, HTML2 string")
    got = html.extracted(rows).first()
    assert got.asDict() == {"page_id": 1, "_html": "a", "__html": "b", "HTML2": "c", "text": "First one, a paragraph with a stop.", "n_chars": 35}


def test_html_query(spark, tmp_path):
    got = html.op2_html(spark, SF).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"] and (got.text.str.len() == got.n_chars).all() and (got.n_chars > 0).all()
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article>a</article>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html.op2_html(spark, save(rows, tmp_path / "p", "pages")).collect()) == ["", "a"]


# op 3

def brute(vectors):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    return near.sum(axis=1), root


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    rows = [(c + rng.standard_normal(32) * 0.16 * np.linalg.norm(c) / np.sqrt(32)).tolist() for c in centres for _ in range(15)] + rng.standard_normal((60, 32)).tolist()
    rows += [rows[0]] * 5
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).orderBy("vec_id").toPandas()
    n, root = brute(rows)
    assert got["n_links"].sum() >= 0.99 * n.sum() and (got["n_links"] <= n).all()
    assert (got["component_id"] == root).mean() > 0.98


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (9, []), (10, [1e-300, 0.0]), (11, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert embeddings.near_duplicates(df.where("false")).count() == 0 and embeddings.near_duplicates(df.where("vec_id = 4")).count() == 1


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows, n, root = [], [], []
    for dim, groups in ((24, 6), (31, 4), (32, 1)):
        some = [(c + rng.standard_normal(dim) * 0.05).tolist() for c in rng.standard_normal((groups, dim)) for _ in range(5)]
        a, b = brute(some)
        n, root, rows = [*n, *a], [*root, *(len(rows) + x for x in b)], [*rows, *some]
    rows.append(rng.standard_normal(40).tolist())  # one stray vector, longer than all
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).orderBy("vec_id").toPandas()
    assert got["n_links"].tolist() == [*n, 0] and got["component_id"].tolist() == [*root, len(rows) - 1] and sum(n) > 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = x @ embeddings.rotations(64, 64)
    code = np.sign(t) / 8
    estimate = code @ t.T / (code * t).sum(axis=1)[:, None]
    off = ~np.eye(300, dtype=bool)
    assert abs((estimate - x @ x.T)[off].mean()) < 1e-3


# op 4

def test_mpeg_round_trip(spark, odd, empty, tmp_path):
    got = {(r["doc_id"], r["n_bytes"]): r for r in mpeg.op4_mpeg(spark, save(odd, tmp_path / "a")).collect()}
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert mpeg.op4_mpeg(spark, save(empty, tmp_path / "b")).count() == 0


@given(st.binary(max_size=4000), st.binary(max_size=60))
@settings(max_examples=60, deadline=None)
def test_mpeg_resynchronises(data, junk):
    payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
    whole = mpeg.wrap(payload)
    s = mpeg.scan(whole)
    assert mpeg.unwrap(whole, s) == payload and s.crc_bad == 0 and s.skipped == 0 and s.table == "Xing" and s.table_frames == len(s.offsets) and s.samples == 1152 * len(s.offsets) and s.id3v1
    junk = junk.replace(b"\xff", b"")
    cut = s.offsets[-1]
    t = mpeg.scan(whole[:cut] + junk + whole[cut:])
    assert len(t.offsets) == len(s.offsets) and t.skipped == len(junk)


def test_mpeg_checks():
    whole = bytearray(mpeg.wrap(b"x" * 192 * 9))
    s = mpeg.scan(bytes(whole))
    assert [h.kbps for h in s.headers] == [320, 320, 80] and s.crc_ok == 3
    whole[s.offsets[1] + 4] ^= 1
    assert mpeg.scan(bytes(whole)).crc_bad == 1
    assert mpeg.scan(b"").samples == 0 and mpeg.scan(b"\xff" * 100).offsets == [] and mpeg.feature(mpeg.scan(b"abc"))
    vbri = bytearray(mpeg.wrap(b"x" * 192))
    first = 30
    vbri[first + 23 : first + 27] = b"\0\0\0\0"
    vbri[first + 36 : first + 40] = b"VBRI"
    vbri[first + 46 : first + 62] = struct.pack(">II4H", 480, 1, 2, 3, 2, 1)
    vbri[first + 62 : first + 66] = struct.pack(">2H", 80, 40)
    found = mpeg.scan(bytes(vbri))
    assert found.table == "VBRI" and found.table_frames == 1 and found.seek_points == [240, 120]


def test_mpeg_reads_stay_inside_their_frames():
    small = bytes([0xFF, 0xF3, 0x14, 0xC4])  # a frame of 24 bytes
    assert mpeg.header(small).size == 24
    for mark in (b"Xing", b"Info"):
        cut = (small + bytes(9) + mark + b"\xff\xff\xff\xff").ljust(24, b"\xff")
        s = mpeg.scan(cut * 1 + small + bytes(20))
        assert s.table == mark.decode() and s.table_bytes is None and s.seek_points == [] and len(s.offsets) == 1
        assert mpeg.scan(cut).table is not None and mpeg.scan(cut[:20]).offsets == []
    head = bytes([0xFF, 0xFB, 0x90, 0xC4])
    vbri = (head + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">II4H", 1, 2, 60000, 1, 4, 1)).ljust(mpeg.header(head).size, b"\x01")
    assert len(mpeg.scan(vbri + vbri).seek_points) == (mpeg.header(head).size - 62) // 4
    wide = bytearray(vbri)
    wide[58:60] = b"\0\0"  # entries of no bytes
    assert mpeg.scan(bytes(wide) * 2).seek_points == []


@given(st.lists(st.sampled_from([b"Xing", b"Info", b"VBRI", b"ID3", b"ID3\x04\0\x40\0\0\0\x14", b"TAG", b"TIT2", b"\xff\xf3\x14\xc4", b"\xff\xfb\x90\xc4", b"\xff\xfc\x14\x40", b"\xff\xfe\x10\x50", b"\xff\xff\xff\xff", b"\0" * 9, b"\0" * 32, b"\x07"]), max_size=24), st.binary(max_size=40), st.integers(0, 300))
@settings(max_examples=400, deadline=None)
def test_mpeg_never_fails(marks, tail, cut):
    data = b"".join(marks) + tail
    for x in (data, data[:cut], data[cut:]):
        s = mpeg.scan(x)
        assert mpeg.feature(s) and s.skipped >= 0 and all(o + n <= len(x) for o, n in zip(s.offsets, s.sizes))


def _bits_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ b
        c = c << 1 & 0xFFFF
        c ^= 0x8005 if top else 0
    return c


@pytest.mark.parametrize("two,three,nbal", [
    (0xFE, 0x34, 4 * 64), (0xFE, 0x34 | 0, 4 * 64),  # layer I, stereo
    (0xFC, 0xA4, None), (0xFC, 0x14, None), (0xFC, 0x48, None), (0xF4, 0x84, None),  # layer II: 48 kHz at several rates, 32 kHz, the second version
])
@pytest.mark.parametrize("mode", [0x00, 0x40, 0x60, 0xC0])
def test_mpeg_checksums_of_layers_one_and_two(two, three, nbal, mode):
    head = bytes([0xFF, two, three, mode])
    h = mpeg.header(head)
    if h is None:
        return
    rng = np.random.default_rng(two + three + mode)
    body = bytes(rng.integers(0, 256, h.size - 6, dtype=np.uint8))
    bits = [x >> (7 - k) & 1 for x in body for k in range(8)]
    channels, at, scf = 1 if mode == 0xC0 else 2, 0, 0
    bound = {0x40: 4, 0x60: 12}.get(mode, 32)
    widths = [4] * 32 if h.layer == 1 else [4] * 4 + [3] * 7 + [2] * 19 if h.version == 2 else mpeg.allocation_bits(h)
    for sb, width in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            value = int("".join(map(str, bits[at : at + width])), 2)
            at += width
            scf += (1 if sb < bound else channels) if value else 0
    n = at + (2 * scf if h.layer == 2 else 0)
    if n > len(bits):
        return
    crc = _bits_crc([x >> (7 - k) & 1 for x in head[2:] for k in range(8)] + bits[:n])
    good = head + struct.pack(">H", crc) + body
    bad = head + struct.pack(">H", crc ^ 1) + body
    s = mpeg.scan(good + bad + good)
    assert (s.crc_ok, s.crc_bad, len(s.offsets)) == (2, 1, 3)


def test_mpeg_allocation_tables():
    sizes = lambda *four: len(mpeg.allocation_bits(mpeg.header(bytes(four))))
    assert (sizes(0xFF, 0xFD, 0xA4, 0), sizes(0xFF, 0xFD, 0xA0, 0), sizes(0xFF, 0xFD, 0x10, 0xC0), sizes(0xFF, 0xFD, 0x18, 0xC0), sizes(0xFF, 0xFD, 0x50, 0xC0)) == (27, 30, 8, 12, 27)


def test_id3_text_frames():
    frame = lambda name, body: name + struct.pack(">I", len(body)) + b"\0\0" + body
    frames = frame(b"TIT2", b"\x03T\xc3\xa9\0") + frame(b"TPE1", b"\x01" + "Name".encode("utf-16")) + frame(b"TXXX", b"\0a\0b") + frame(b"TALB", b"\0Al\xe9") + frame(b"TCON", b"\x09x") + b"TYER\0\0\0\x7f\0\0\0cut"
    tag = b"ID3\x04\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames
    s = mpeg.scan(tag + mpeg.wrap(b"x" * 192))
    assert s.tags == {"TIT2": "Té", "TPE1": "Name", "TALB": "Alé", "TSSE": "payload"} and s.title == "Té"
    old = b"TT2\0\0\x03\0ab"
    assert mpeg.scan(b"ID3\x02\0\0\0\0\0" + bytes([len(old)]) + old).tags == {"TT2": "ab"}


def test_mpeg_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(mpeg.wrap(b"y" * 384))), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    got = {r["id"]: r for r in mpeg.analysed(rows).collect()}
    assert got[1]["duration_s"] == 1152 / 48000 and got[1]["frame_offsets"] == [270] and got[2]["n_frames"] is None and got[3]["n_frames"] == 0


# op 5

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@given(st.lists(st.text(alphabet="aabbeeerstnio  ▁Tdñé\n\t01.日🎉\x00á", max_size=20), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(library, texts):
    m = pieces.load(pieces.default_model())
    for t, ids in zip(texts, m.encode_all(texts)):
        want = library.encode(t)
        assert ids.tolist() == want == m.encode(t) and m.shown_text(ids) == library.decode(want) == m.decode(want)


def test_pair_tests():
    m, rng = pieces.load(pieces.default_model()), np.random.default_rng(1)
    some = [p for p in m.ids if not p.startswith("▁") and m.is_whole(p)]
    for a, b in zip(rng.choice(some, 1500), rng.choice(some, 1500)):
        assert m.compatible(str(a), str(b)) == (m.merged(a + b) == [a, b])


def test_pairs_of_new_words_are_kept_once():
    m = pieces.MergePieces(open(pieces.default_model(), "rb").read())
    m.encode_all(["several new words of one text", "and others"])
    assert m.tested.n > 10 and not m.pairs  # in arrays, not in a table of strings as well


def test_words_of_unknown_characters_are_kept_in_arrays(library):
    m, texts = pieces.MergePieces(open(pieces.default_model(), "rb").read()), ["some wo\ue000rds 日\ue000 of \ue000\ue000unknown charac\ue000", "ot\ue000hers  \ue000"]
    assert [x.tolist() for x in m.encode_all(texts)] == [library.encode(t) for t in texts]
    assert not m.pairs  # their pair tests filled a table of strings


def test_pieces_query(spark, odd, empty, library, tmp_path):
    got = pieces.op5_sentencepiece(spark, save(odd, tmp_path / "a")).collect()
    want = Counter((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, t, *_ in ODD for x in [library.encode(t or "")])
    assert Counter(tuple(r) for r in got) == want
    assert pieces.op5_sentencepiece(spark, save(empty, tmp_path / "b")).count() == 0 and pieces.encoded(odd).count() == len(ODD)


# op 6

@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.integers(1, 30), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_frame_is_fair(weights):
    frame, done = sum(weights.values()), Counter()
    for s, k, slot in mixing.frame_schedule(weights):
        assert k == done[s] and k * frame // weights[s] <= slot < -(-(k + 1) * frame // weights[s])
        done[s] += 1
        assert all(abs(done[x] - (slot + 1) * w / frame) < 1 for x, w in weights.items())
    assert done == weights


def test_mixing_rows(spark, odd, empty, tmp_path):
    assert mixing.op6_mixing(spark, save(odd, tmp_path / "a")).count() == len(ODD) and mixing.op6_mixing(spark, save(empty, tmp_path / "b")).count() == 0
    out = mixing.in_order(odd)
    assert out.columns == odd.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, odd.collect()))
    with pytest.raises(ValueError):
        mixing.frame_schedule({"a": 0})


def test_the_schedule_starts_no_python_workers(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{save(odd, tmp_path / 'a')}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") == 2 and "RDD" not in plan


# op 7

def test_licenses(spark, empty):
    mit = next(x for n, _, x in licenses.TEMPLATES if n == "mit-grant")
    rows = [(1, "prose " * 50 + "\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0"), (4, "nothing"), (5, None), (6, "x " * 3000 + mit.upper() + " y" * 3000), (7, " ".join(mit.split()[:20])),
            (8, "This work is licensed under the GNU General Public License, version 3."), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["template"]) for r in licenses.scan(docs).where("best").collect())
    assert got == [(1, "mit-line"), (2, "cc-by-nc-line"), (3, "cc-by-line"), (6, "mit-grant"), (8, "gpl3-line")]
    assert licenses.scan(empty).count() == 0


def test_licenses_plan_is_native(spark):
    plan = licenses.op7_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_licenses_against_brute_force(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["template"], r["best"]) for r in licenses.op7_licenses(spark, SF).collect()}
    sh = lambda x: [" ".join(w[i : i + 5]) for w in [re.findall("[a-z0-9]+", x.lower())] for i in range(len(w) - 4)]
    want = set()
    for r in docs.collect():
        mine, found = sh(r["text"]), []
        for name, _, text in licenses.TEMPLATES:
            t = set(sh(text))
            if (share := len(t & set(mine)) / len(t)) >= licenses.CONTAINED:
                first = next(x for x in dict.fromkeys(sh(text)) if x in mine)
                found.append((share, mine.index(first), name))
        want |= {(r["doc_id"], n, not any(o == at and s2 > s for s2, o, _ in found)) for s, at, n in found}
    assert got == want


def test_every_template_that_is_contained_is_returned(spark):
    notice = next(x for n, _, x in licenses.TEMPLATES if n == "apache-notice").replace("http://", "https://")
    got = {r["template"]: r for r in licenses.scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).collect()}
    assert {"apache-line", "apache-notice"} <= set(got) and 0.8 < got["apache-notice"]["containment"] < 1


# op 8

def union_find(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    for i in range(n):
        up[i] = up[up[i]]
    return up


def test_fingerprint():
    from xxhash import xxh64_intdigest

    def slow(text):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hs = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)] if len(w) >= 3 else [xxh64_intdigest(" ".join(w).encode(), 42)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in ("", " \t", "one", "One two", "a b c", "É a\x85b c d\xa0e a b c d", "x y " * 50):
        assert simhash.fingerprint(t) == slow(t)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("limit", [128, 2])
def test_simhash_links_exactly(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST", limit)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(25))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in shared.components(simhash.links(df)).collect()}
    signed = np.sort(fps.view(np.int64))
    near = [(i, j) for i in range(len(signed)) for j in range(i + 1, len(signed)) if int(signed[i] ^ signed[j]).__and__((1 << 64) - 1).bit_count() <= 2]
    root = union_find(len(signed), near)
    mine = [got.get(int(x), int(x)) for x in signed]
    assert all((mine[i] == mine[j]) == (root[i] == root[j]) for i in range(len(signed)) for j in range(i))


def test_simhash_odd_rows(spark, odd, empty, tmp_path):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.op8_simhash(spark, save(odd, tmp_path / "a")).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == 1 and {v for (i, _), v in got.items() if i in (3, 4)} == {3}
    assert simhash.op8_simhash(spark, save(empty, tmp_path / "b")).count() == 0
    kept = simhash.keep_one(odd.withColumn("wide", F.lit(1)))
    assert kept.columns == [*odd.columns, "wide"] and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, None, 5, 6])
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("short,block", [(64, 512), (3, 4)])
def test_near_copies(spark, monkeypatch, short, block):
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    make = lambda: [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for _ in range(8):
        base = make()
        texts.append(base)
        for _ in range(6):
            c = list(base)
            c[int(rng.integers(0, 150))] = "changed"
            texts.append(c)
    texts += [make() for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [7 * i for i in range(8)] + list(range(56, 86))


@pytest.mark.parametrize("short,block,few", [(64, 512, 64), (3, 4, 64), (3, 4, 0)])
def test_near_copies_against_brute_force(spark, monkeypatch, short, block, few):
    for k, v in (("SHORT", short), ("BLOCK", block), ("FEW", few or simhash.FEW), ("SAMPLE", 1 if not few else simhash.SAMPLE)):
        monkeypatch.setattr(simhash, k, v)
    rng = np.random.default_rng(4)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.choice([9, 20, 60, 100, 200])))]
        texts.append(words)
        for _ in range(3):  # around 0.8, on both sides of it
            c = list(words)
            n = max(1, int(len(c) * rng.uniform(0.02, 0.12)))
            at = int(rng.choice([0, rng.integers(0, len(c) - n)]))
            c[at : at + n] = [f"x{x}" for x in rng.integers(0, 5000, n)]
            texts.append(c)
    texts = [" ".join(t + (["one", "very", "common", "line", "of", "text"] if i // 4 % 2 else [])) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    share = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
    near = [p for p, x in share.items() if x >= 0.8]
    assert len(near) > 20 and sum(0.7 <= x < 0.8 for x in share.values()) > 20
    root = union_find(len(texts), near)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_near_copies_come_through_the_byte_position_index(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        texts.append(words)
        for k in range(3):  # one word at the end: fingerprints stay within the index's bits, or are equal
            texts.append([*words, f"x{k}"])
        texts.append([*words[:540], *(f"y{x}" for x in rng.integers(0, 5000, 40))])  # similar, with a far fingerprint
    texts += [[f"w{x}" for x in rng.integers(0, 5000, 600)] for _ in range(5)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    fps = [simhash.fingerprint(" ".join(t)) for t in texts]
    near = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= simhash.BITS]
    root = union_find(len(texts), near)
    assert len(set(root)) == 17  # the families' three near copies alone
    compared, close = [], simhash._close
    monkeypatch.setattr(simhash, "_close", lambda pairs, *a: close(compared.append(pairs.count()) or pairs, *a))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [5 * i for i in range(6)] + list(range(30, 35))
    assert compared[0] >= 18  # pairs that fingerprints found
    monkeypatch.setattr(simhash, "prefix", lambda base, *a: base[:0])  # without the way for the rest
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_bitmaps_never_drop_a_similar_pair():
    rng = np.random.default_rng(8)
    kept = {True: 0, False: 0}
    for n in (5, 60, 130, 300, 3000):
        for share in np.linspace(0.7, 1, 40):
            x = rng.integers(0, 1 << 63, n).astype("<u8")
            y = np.concatenate([x[: int(n * share)], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.15))).astype("<u8")])
            a, b = simhash.bitmap(x), simhash.bitmap(y)
            m = min(len(a), len(b))
            may = simhash.possible(simhash.folded(a, m), simhash.folded(b, m), np.int64(len(x)), np.int64(len(y)), 0.8)
            coarse = simhash.possible(simhash.folded(a, simhash.WIDE), simhash.folded(b, simhash.WIDE), np.int64(len(x)), np.int64(len(y)), 0.8)
            near = simhash.similar(np.sort(x), np.sort(y), 0.8)
            assert (may and coarse) or not near
            kept[bool(may)] += not near
    assert kept[False] > 2 * kept[True]


def test_stages_leave_clashing_columns_alone(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, None), (4, "h i j k l m n", "x")]
    names = ("_doc", "_th", "doc", "id", "_row", "_source", "_order", "_bucket", "_k", "_sum")
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.where("doc_id <> 2").collect(), key=str)
    mixed = mixing.in_order(docs)
    assert mixed.columns == docs.columns and sorted(mixed.collect(), key=str) == sorted(docs.collect(), key=str)


# op 9

def test_language(spark, tmp_path):
    got = language.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def test_language_odd_rows(spark, odd, empty, tmp_path):
    rows = odd.union(spark.createDataFrame([(i, "the quick brown fox jumps over it", "en", "a", 1) for i in range(100, 140)] + [(i, "le renard brun saute par dessus", "fr", "a", 1) for i in range(200, 240)] + [(300, "12 34 !?", "en", "a", 1)], DOCS))
    got = {r["doc_id"]: r for r in language.op9_language(spark, save(rows, tmp_path / "a")).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[300]["lang_pred"] == "und" and got[100]["lang_pred"] == "en" and got[200]["lang_pred"] == "fr"
    assert language.op9_language(spark, save(empty, tmp_path / "b")).count() == 0
    none = language.op9_language(spark, save(odd.withColumn("lang", F.lit(None).cast("string")), tmp_path / "c")).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(ODD)


def test_joint_models_equal_each_of_them():
    models = [language.CharacterModel.fit(Counter(ws)) for ws in (["abba", "abab", "bab", "ba"], ["über", "aber", "ab", "ab"], ["x"])]
    c, said = language.codes(["abba", "aber", "zz", "x", "b"])
    hs, at = language.hashes(c), np.flatnonzero(said)
    assert np.array_equal(language.JointModels(models).bits(hs, at), np.stack([m.bits(hs, at) for m in models], axis=1))


def test_kneser_ney_sums_to_one():
    m = language.CharacterModel.fit(Counter(["abba", "abab", "bab", "ba"]))
    alphabet = "ab "
    for before in ("   a", "  ab", " abb"):
        total = 0.0
        for ch in alphabet:
            c = np.array([ord(x) for x in before + ch], np.uint64)
            total += 2 ** -m.bits(language.hashes(c), np.array([4]))[0]
        assert total == pytest.approx(1 - _unseen(m), abs=0.02)


def _unseen(m):
    return float(m.weights[0][0]) * m.floor * 1


# op 10

@given(st.lists(st.integers(0, 6), max_size=400))
@settings(max_examples=100, deadline=None)
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blob = repair.pack(ids)
    assert (repair.decode(blob) == ids).all()
    for a, b in ((0, 3), (5, 50), (len(ids) - 3, len(ids) + 5)):
        assert (repair.decode_range(blob, a, b) == ids[max(0, a) : b]).all()


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(1, 7), min_size=40, max_size=40), st.integers(2, 9))
@settings(max_examples=300, deadline=None)
def test_grammar_ends_on_runs(ids, times, frequent):
    x = np.repeat(np.array(ids, np.int64), times[: len(ids)])
    base, rules, lengths, seq = repair.grammar(x, frequent)
    assert (repair.expand(base, rules, lengths, seq) == x).all()
    if frequent == 2:  # no pair is left that could be replaced twice
        counts, before = Counter(), {}
        for i, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if pair[0] != pair[1] or before.get(pair) != i - 1:
                counts[pair] += 1
                before[pair] = i
        assert max(counts.values(), default=0) < 2


def test_grammar_compresses():
    ids = np.tile(np.arange(20, dtype=np.uint32), 500)
    base, rules, lengths, seq = repair.grammar(ids)
    assert base == 20 and len(seq) < len(ids) / 8 and lengths.max() > 8


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    for ids in (np.tile(np.arange(3), 5000), rng.integers(0, 40, 20_000), rng.zipf(1.3, 50_000) % 5000, np.zeros(3000)):
        base, rules, lengths, seq = repair.grammar(ids.astype(np.uint32))
        assert (repair.expand(base, rules, lengths, seq) == ids).all()
        apart, last = Counter(), {}
        for i, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                apart[pair] += 1
                last[pair] = i
        assert max(apart.values(), default=0) < repair.FREQUENT


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_token_files(spark, odd, empty, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(repair.default_tokenizer())
    tok.encode_special_tokens = True
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in ODD]
    path = shared.fresh_path(spark, "t")
    repair.write(odd, path, shard_tokens=size)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read(spark, path).collect())
    want, at = [], 0
    for i, x in sorted(((-1 if i is None else i), x) for i, x in ids):
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == sorted(want)
    path = shared.fresh_path(spark, "e")
    repair.write(empty, path)
    assert repair.read(spark, path).count() == 0


def test_chunks_equal_whole_texts():
    enc = repair.Encoder(repair.default_tokenizer())
    for t in ("a  b   c ", " \n x", "it's <|endoftext|> x  y", "a\x1c b\x1f  c", "\t\t d", "日本 語  x", "e' ll 're  "):
        assert enc.ids([t])[0] == np.array([*enc.tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


@given(st.lists(st.text(alphabet="aBzéñÿ×ßƏǅ0'.,!#_\n\t -\u00a0漢", max_size=12), max_size=12))
@settings(max_examples=400, deadline=None)
def test_plain_words_equal_the_library(words):
    enc = repair.load(repair.default_tokenizer())
    for text in (" ".join(words), "x " + " ".join(words) + " don't a.\nb c,\n d'll\ne"):
        assert enc.ids([text])[0] == np.array([*enc.tok.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_plain_words_take_the_short_way():
    enc = repair.Encoder(repair.default_tokenizer())
    assert all(enc.plain(w) is not None for w in ("word", "Größe.", "one.\nTwo", "a,\nb\nc!?", "x-")) and all(enc.plain(w) is None for w in ("", "it's", "x1", "a\n", "a\n\nb", "\na", "漢", ".a", "a\tb"))


def test_added_tokens_as_by_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(repair.default_tokenizer())
    texts = ["end <|endoftext|> next", "plain text", "<|endoftext|>", "a <|endoftext|>b  c<|endoftext|>", None]
    assert repair.load(repair.default_tokenizer()).ids(texts) == [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 1306]


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).toPandas()
    want = {r["doc_id"] for r in simhash.keep_one(language.identify(docs, language.train(docs)).where("not rejected")).select("doc_id").collect()}
    assert set(got.doc_id) == want and set(docs.columns) <= set(got.columns) and 0.8 * docs.count() < len(got) < docs.count()
    m = pieces.load(pieces.default_model())
    assert all(m.encode(t) == list(x) and t == d for t, x, d in zip(got.text[:20], got.piece_ids[:20], got.decoded[:20]))


def test_pipeline_emits_the_mixture(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:])
    rng = np.random.default_rng(6)
    rows = [(i, "w" * int(rng.integers(1000, 30000)), "en", ("src0", "src1", "src3")[i % 3], 0) for i in range(600)]
    got = corpus_pipeline.run(spark, save(spark.createDataFrame(rows, DOCS).repartition(5), tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    place = [(r["slot"], r["rank_in_block"]) for r in got]
    assert place == sorted(place)
    weights = {"src0": 120, "src1": 80, "src3": 20}
    total, done = {s: sum(len(r["text"]) + mixing.ROW_BYTES for r in got if r["source"] == s) for s in weights}, dict.fromkeys(weights, 0)
    for r in got:  # until a source runs out each has its share to within a block and a row
        done[r["source"]] += len(r["text"]) + mixing.ROW_BYTES
        if any(done[s] + 2 * mixing.BLOCK_BYTES > total[s] for s in weights):
            break
        assert all(abs(done[s] - sum(done.values()) * w / 220) < 2 * mixing.BLOCK_BYTES for s, w in weights.items())
    assert sum(done.values()) > 20 * mixing.BLOCK_BYTES
def test_marks_of_words():
    e = repair.Encoder(repair.default_tokenizer())
    for c in map(chr, range(0x250)):
        assert (c in repair.MARKS) == (repair.PLAIN("a" + c) is not None and not c.isalpha())
    words = {w + c for w in ("word", "élan", "it's", "x9", "日本", "ªb") for c in ["", *repair.MARKS, "?!", "\'", "\n", ".\nNext,"]} | {*repair.MARKS, "--"}
    for w in words:
        assert e.ids([f"a {w} b"]) == [np.array([*e.tok.encode(f"a {w} b", add_special_tokens=False).ids, repair.END], "<u4").tobytes()]


