"""The training-data operators against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kd_trees, near_dedup, packing, quality, queries, rp_forest, secrets, segmentations, suffix_dedup, token_files, tokens, toxicity
from lodestone.llm.queries import vocabulary

WORD, BYTE, PIECE = (vocabulary(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, th int, node string, length int, `rank` int, places string, score double"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(9000))
    texts = [(1, "plain words stand here in a row"), (2, None), (3, ""), (4, "plain words stand here in a row"), (4, "plain words stand here in a row"), (None, "no id at all"), (None, "no id at all"), (5, long), (6, "ab" * 300), (7, "\n\t  "), (8, "Straße ÉÇ 你好 don't İi ́x"), (8, "another text of id 8"), (-9, "x")]
    return [(d, t, None, "s", None, 1, 2, "n", 3, 4, "p", 0.5) for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    hard = ["", " ", "  a  b ", "it's don't 'start x's", "a\n\n b\t c", "Éçò ß İ ŉ Σας", "x1y22 3.4,,, !! $$$", "你好 мир z", "á b́", "<|endoftext|> x", "  \n  ", "A|B | c-d_e", "ſK"]
    for path in (WORD, BYTE):
        e, ids = tokens.Encoder(path), library(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(hard)] == [ids(t) for t in hard]


def test_words_are_encoded_without_the_librarys_splitting():
    """Words of the byte vocabulary go to the library's model alone (splitting was half of their cost), whatever letters they have; ids are the whole library's."""
    e, ids, split = tokens.Encoder(BYTE), library(BYTE), []
    whole = e.tokenizer

    class Seen:
        model = whole.model

        def encode_batch_fast(self, texts, **options):
            split.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    e.tokenizer = Seen()
    letters = [chr(c) for c in range(0x300) if chr(c).isalpha()]
    texts = ["the Quick  thequickbrownfx, Éçòßɏe\n Thstinnt1 zèêeau  ", "мир you'll don't x", " ".join(letters), "".join(letters), "a".join(letters)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [ids(t) for t in texts]
    assert split and not any(w in x for x in split for w in ("Quick", "thequickbrownfx", "Éçòßɏe", "Thstinnt", "zèêeau"))


def check_packing(rows, want):
    by = {}
    for r in rows:
        assert 0 < r.length <= 4096
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    pieces = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expected = []
    for d, ids in want:
        for a in range(0, len(ids), 4096):
            own = ids[a : a + 4096]
            expected.append((d is not None, d or 0, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids)))
    assert pieces == sorted(expected)


def test_packing(docs, texts, odd):
    ids = library(WORD)
    check_packing(packing.pack(docs, WORD).collect(), [(d, [*ids(t), 2]) for d, t in texts.items()])
    check_packing(packing.pack(odd, WORD).collect(), [(r[0], [*ids(r[1]), 2]) for r in odd_rows()])
    assert packing.pack(odd.limit(0), WORD).count() == 0


def test_plans_hold_the_histogram():
    r = random.Random(1)
    for _ in range(60):
        size = r.choice([8, 64, 4096])
        h = {r.randint(1, size): r.choice([1, 3, 1000]) for _ in range(r.randint(1, 40))}
        got = {}
        for n, parts in packing.plan_packs(h, size):
            assert n > 0 and sum(a * b for a, b in parts) <= size
            for length, copies in parts:
                got[length] = got.get(length, 0) + n * copies
        assert got == h


def test_token_files(spark, docs, texts, odd, tmp_path):
    ids = library(BYTE)
    rows = sorted(token_files.round_trip(docs, BYTE).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (d, t) in zip(rows, sorted(texts.items()), strict=True):
        own = [*ids(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    path = str(tmp_path / "files")
    token_files.write(odd, path, BYTE)
    got = token_files.read(spark, path).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids(t)) + 1 for _, t, *_ in odd_rows())
    assert token_files.export(spark, path, str(tmp_path / "out")) > 0
    assert token_files.round_trip(odd.limit(0), BYTE).count() == 0


def test_blocks():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 2, 300, 50257):
            ids = r.integers(0, top, n).astype(np.uint32)
            ids[r.random(n) < 0.02] = 50256
            cuts = [n // 3, n - n // 3]
            image = token_files.Image(token_files.encode(ids, [5, None], cuts))
            assert (image.ids() == ids).all() and image.doc_ids == [5, None]
            assert (image.document(0) == ids[: n // 3]).all() and (image.document(1) == ids[n // 3 :]).all()
            assert all((image.read(b, b + 1) == ids[128 * b : 128 * b + 128]).all() for b in range(image.blocks))


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        rest = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts, odd):
    r = random.Random(5)
    passage = "".join(r.choice("abcdé ") for _ in range(180))
    planted = {i: "".join(r.choice("abc é") for _ in range(r.randint(0, 300))) + passage[r.randint(0, 60) :] + "z" * r.randint(0, 250) for i in range(60)}
    for frame, rows in ((docs, texts), (spark.createDataFrame(list(planted.items()), "doc_id long, text string"), planted)):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(frame).collect()}
        assert got == brute_removal(rows.items())
    assert suffix_dedup.digest(odd).count() == len(odd_rows()) and suffix_dedup.digest(odd.limit(0)).count() == 0
    kept = suffix_dedup.remove(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").first().text == "plain words stand here in a row"


@pytest.mark.parametrize("id_", [None, 7])
def test_suffix_dedup_where_rows_share_an_id(spark, id_):
    """Different texts of one id: exactly one of them keeps the passage they share, unique texts stay, and so do copies of a row."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(160))
    own = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(100, 300))) for _ in range(600)]
    texts_ = [t + "#" + passage + "#" if i % 2 else t for i, t in enumerate(own)]
    frame = spark.createDataFrame([(id_, t) for t in [*texts_, texts_[0], texts_[0], None]], "doc_id long, text string")
    rows = suffix_dedup.digest(frame).collect()
    assert len(rows) == 603 and {x.doc_id for x in rows} == {id_}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((x.n_bytes, x.n_removed, x.kept_sha256) for x in rows)
    plain = [(len(t), 0, sha(t)) for t in [*texts_[::2], texts_[0], texts_[0], ""]]
    # a character or two before the passage may happen to be those of an earlier text
    cut = {(len(t), n, sha(t[:-n])) for t in texts_[1::2] for n in range(162, 168)}
    whole = {(len(t), 0, sha(t)) for t in texts_[1::2]}
    rest = list(got)
    for x in plain:
        rest.remove(x)
    assert len(rest) == 300 and sum(x in whole for x in rest) == 1 and sum(x in cut for x in rest) == 299
    left = [x.text for x in suffix_dedup.remove(frame).collect()]
    assert len(left) == 603 and left.count(None) == 1 and sum(passage in (x or "") for x in left) == 1 and set(texts_[::2]) <= set(left)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_alignment_and_bounds():
    r = random.Random(1)
    pairs = []
    for _ in range(150):
        a = [r.randrange(60) for _ in range(r.randint(1, 60))]
        b = a[:]
        for _ in range(r.randint(0, 20)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = [r.randrange(60)] * r.randint(0, 1)
        pairs.append((np.array(a, np.uint64), np.array(b or [0], np.uint64), r.randint(0, 25)))
    for (a, b, most), got in zip(pairs, near_dedup.edits(pairs)):
        want = levenshtein(a.tolist(), b.tolist())
        assert got == want if want <= most else got > most
        assert near_dedup.chained(a, b) >= want


def brute_classes(rows):
    words = {d: near_dedup.fingerprints(t) for d, t in rows.items()}
    parent = {d: d for d in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(rows), 2):
        x, y = words[a], words[b]
        same = x.tobytes() == y.tobytes() and (len(x) > 0 or rows[a] == rows[b])
        if same or len(x) and len(y) and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and near_dedup.similar([(x, y)])[0]:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in rows}


def test_near_duplicates(spark, docs, texts, odd):
    r = random.Random(7)
    base = [f"v{r.randrange(400)}" for _ in range(300)]
    planted = dict(texts)
    for i in range(30):
        w = base[:]
        for _ in range(r.randint(0, 8)):
            w[r.randrange(300)] = f"e{r.randrange(99999)}"
        planted[10_000 + i] = " ".join(w)
    for i in range(20):  # a common passage in documents that differ
        planted[20_000 + i] = " ".join([*(f"p{j}" for j in range(120)), *(f"q{r.randrange(99999)}" for _ in range(80))])
    frame = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame).collect()}
    assert got == brute_classes(planted)
    assert len({got[20_000 + i] for i in range(20)}) == 20 and len({got[10_000 + i] for i in range(30)}) == 1
    kept = near_dedup.one_of_each(frame)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows()) and {x.class_id for x in rows if x.doc_id in (1, 4)} == {1}
    once = near_dedup.one_of_each(odd)
    assert once.columns == odd.columns and once.where("text = 'no id at all'").count() == 1
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0 and near_dedup.one_of_each(odd.limit(0)).count() == 0


def test_edited_copies_in_large_buckets(spark):
    """Variants of one base link to it alone (edit similarity 0.94, to each other 0.88), and it leads no bucket: it is the longest."""
    r = random.Random(11)
    base = [f"v{r.randrange(4000)}" for _ in range(100)]
    rows = {0: " ".join([*base, "last"])}
    for i in range(1, 241):
        w = base[:]
        for p in r.sample(range(100), 6):
            w[p] = f"e{r.randrange(10**9)}"
        rows[i] = " ".join(w)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_texts_apart_from_a_family_are_not_compared_with_all_of_it(spark, tmp_path, monkeypatch):
    """40 texts share their rare shingles with 160 copies, with a few words changed, that none of them is linked to: 6,400 pairs that no leader settles."""
    r = random.Random(17)
    base = [f"v{i}" for i in range(150)]
    rows = {}
    for i in range(200):
        w = base[:]
        for p in r.sample(range(150), r.choice((14, 15) if i % 5 == 0 else (5, 6))):
            w[p] = f"e{r.randrange(10**9)}"
        rows[i] = " ".join(w)
    verified, log = near_dedup.verified, str(tmp_path)

    def counted(batches):
        import uuid

        for b in batches:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(b)))
            yield from verified(iter([b]))

    monkeypatch.setattr(near_dedup, "verified", counted)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert sum(got[i] == i for i in rows) > 30
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 4000


def test_marks_differ_by_no_more_than_their_sets():
    r = np.random.default_rng(5)
    for common, a, b in ((300, 20, 15), (5, 2, 0), (0, 1, 900), (2000, 300, 300)):
        h = r.integers(0, 2**64, common + a + b, np.uint64)
        x, y = (near_dedup.marks(s).view(np.uint64) for s in (h[: common + a], np.concatenate([h[:common], h[common + a :]])))
        assert 0 < int(np.bitwise_count(x ^ y).sum()) <= a + b


def test_secret_patterns(spark, odd):
    key = "AKIA" + "Z9" * 8
    text = f'é Password: "abcd1234" token=short secret = {"0af9" * 10} {key} {"deadbeef" * 4}g API_KEY=x.y/z+w=1'
    rows = secrets.digest(secrets.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (3, 1, 2)
    spans = [s.split(":") for s in rows[0].spans.split(",")]
    found = {(k, text[int(a) : int(z)]) for k, a, z in spans}
    assert found == {("assign", "abcd1234"), ("assign", "0af9" * 10), ("assign", "x.y/z+w=1"), ("access", key), ("hex", "0af9" * 10), ("hex", "deadbeef" * 4)}
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
    assert secrets.redact(odd).count() == len(odd_rows()) and secrets.find(odd.limit(0)).count() == 0


def test_families_of_two_that_only_edits_link(spark):
    """Of 400 pairs with an edit similarity of 0.92 and a low Jaccard similarity none that shares a sketch is lost, in buckets of every size: half of the texts share a passage."""
    r = random.Random(13)
    passage = [f"p{j}" for j in range(30)]
    rows = {}
    for i in range(400):
        own = [f"v{r.randrange(3000)}" for _ in range(100 if i % 2 else 70)]
        base = own if i % 2 else own[:35] + passage + own[35:]
        other = base[:]
        for p in r.sample([p for p in range(100) if i % 2 or not 35 <= p < 65], 8):
            other[p] = f"e{r.randrange(10**9)}"
        rows[2 * i], rows[2 * i + 1] = " ".join(base), " ".join(other)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame).collect()}
    words = {d: near_dedup.fingerprints(t) for d, t in rows.items()}
    meet = [i for i in range(400) if (near_dedup.sketches(words[2 * i]) == near_dedup.sketches(words[2 * i + 1])).any()]
    assert len(meet) > 250 and near_dedup.similar([(words[2 * i], words[2 * i + 1]) for i in range(400)]).all()
    assert [i for i in meet if got[2 * i] != got[2 * i + 1]] == []
    assert all(got[d] in (d, d - d % 2) for d in rows)


def test_near_duplicates_without_ids(spark):
    """Very many different texts without an id are texts of their own; copies among them are one."""
    r = random.Random(3)
    texts_ = [" ".join(f"v{r.randrange(3000)}" for _ in range(30)) for _ in range(300)]
    frame = spark.createDataFrame([(None, t) for t in [*texts_, *texts_[:50]]] + [(5, texts_[0])], "doc_id long, text string")
    kept = near_dedup.one_of_each(frame)
    assert sorted(x.text for x in kept.collect()) == sorted(texts_)
    rows = near_dedup.near_duplicates(frame).collect()
    assert len(rows) == 351 and sum(x.class_id == 5 for x in rows) == 3


def scanned(text):
    """The base spans by a scan of its own, character by character: (kind, start, end)."""
    plain, alnum = set("+/_.=-"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    out, i = [], 0
    while i < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(n, i)), None)
        at = i + len(name or "")
        if name:
            at += text[at : at + 1] in ("'", '"') and at < len(text)
            while text[at : at + 1] == " ":
                at += 1
            name = name if text[at : at + 1] in (":", "=") and at < len(text) else None
        if name:
            at += 1
            while text[at : at + 1] == " ":
                at += 1
            at += text[at : at + 1] in ("'", '"') and at < len(text)
            z = at
            while z < len(text) and text[z] in plain | alnum:
                z += 1
            name = name if z > at else None
        if name:
            out += [("assign", at, z)] if z - at >= 8 else []
            i = z
        else:
            i += 1
    for kind, begin, own, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            z = i + len(begin)
            while text.startswith(begin, i) and z < len(text) and text[z] in own:
                z += 1
            if text.startswith(begin, i) and z > i + len(begin):
                out += [(kind, i, z)] if z - i >= least else []
                i = z
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def whole_text_spans(text, crf):
    """Runs of begin and inside in the best tags of the whole text, decoded in one go."""
    spans, x, may = secrets.features(text, 0, len(text), secrets.file_features(text))
    tags, out, begin = crf.tags(x, may) if len(spans) else [], [], 0
    for i, t in enumerate(tags):
        begin = spans[i][0] if t == secrets.B else begin
        if t != secrets.O and (i + 1 == len(tags) or tags[i + 1] != secrets.I):
            out.append((begin, spans[i][1]))
    return out


def test_secrets_of_documents(spark, docs, odd):
    """Counts, hash and spans against the scan above and decoding of whole texts."""
    crf = secrets.model()
    hard = ["token=" + "x" * 7, "token: 'abcdefgh", 'PASSWD" = ' + "a" * 9, "secret=\"\"abcdefghij", "password token=abcdefgh1", "api_key:=abcdefgh", "apikey=" + "=" * 9, "AKIAAKIA" + "Z" * 12, "AKIA" * 3 + "x", "0" * 31 + "g" + "a" * 32, "é secret = abcdefgh\u212a", "", None]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")).unionByName(odd.select("doc_id", "text"))
    by = {}
    for r in frame.collect():
        text = r.text or ""
        base = scanned(text)
        joined = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        added = [("crf", a, z) for a, z in whole_text_spans(text, crf) if not any(a < e and s < z for _, s, e in base)]
        kinds = [sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")]
        spans = sorted(base + added, key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        by.setdefault(r.doc_id, []).append((*kinds, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    got = {}
    for r in secrets.digest(secrets.find(frame)).collect():
        got.setdefault(r.doc_id, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}
    clean = {(r.doc_id, r.text) for r in secrets.redact(frame).collect()}
    assert (10**6 + 12, None) in clean and (10**6 + 1, "token: '<secret>") in clean


def test_secrets_keep_large_ids_beside_null_ones(spark):
    """Ids above 2**53, which no float holds, in one batch with a row without an id."""
    rows = [(2**53 + 1 + i, f"token=abcdefgh{i}") for i in range(4)] + [(2**63 - 1, "plain"), (-(2**63), None), (None, "AKIA" * 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_assign, r.n_access) for r in secrets.digest(secrets.find(frame)).collect()}
    assert got == {d: (int(t is not None and "=" in t), int(d is None)) for d, t in rows}


def test_chains_are_decoded_as_whole_texts_are():
    crf, r = secrets.model(), random.Random(4)
    lines = [t for t, _ in secrets.examples(400, seed=77)]
    texts = list(lines)
    for _ in range(600):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts.append(r.choice(lines))
            if r.random() < 0.4:
                n = r.randint(20, 2000)
                tail = "".join(r.choice("-/_.") + "".join(r.choice("abcdefgh123") for _ in range(r.randint(2, 9))) for _ in range(n // 7))
                parts.append(r.choice(("secret ", "password: ", 'key="', " ", "")) + "".join(r.choice("Ab3dEf9k") for _ in range(9)) + tail)
            parts.append(" " * r.choice((0, 1, 1, 1, 300)) + r.choice(("", "\n", "é ", "key " * 4)))
        texts.append("".join(parts))
    assert all(secrets.crf_spans(t, crf) == whole_text_spans(t, crf) for t in texts)
    text = "secret Ab3dEfgh9k" + "-abcdefg" * 60
    assert secrets.crf_spans(text, crf) == [(7, len(text))]


def test_tagger_on_new_lines():
    lines = secrets.examples(200, seed=99)
    crf = secrets.model()
    hit = near = wrong = 0
    for text, places in lines:
        found = secrets.crf_spans(text, crf)
        near += len(places)
        hit += sum(any(a < z and b < y for b, z in found) for a, y in places)
        wrong += sum(not any(a < z and b < y for b, z in places) for a, y in found)
    assert hit > 0.9 * near and wrong < 0.1 * near


def test_viterbi_is_the_best_path():
    crf = secrets.model()
    for text, _ in secrets.examples(40, seed=3):
        _, x, may = secrets.features(text[:60], 0, min(60, len(text)), (0, 0))
        x, may = x[:7], may[:7]
        if not len(x):
            continue
        s = crf.scores(x, may)
        score = lambda tags: s[0][tags[0]] + (-1e9 if tags[0] == 2 else 0) + sum(crf.move[a][b] + s[i + 1][b] for i, (a, b) in enumerate(zip(tags, tags[1:])))
        best = max(itertools.product(range(3), repeat=len(x)), key=score)
        assert score(tuple(crf.tags(x, may))) == pytest.approx(score(best))


def vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 8)).astype("float32")
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [None] * 8), (604, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (605, [1.0, 2.0]), (5, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def brute_top(m, ids, every, k):
    out = {}
    for i in ids:
        if i % every == 0:
            s = m @ m[i]
            out[i] = [(j, s[j]) for j in sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:k]]
    return out


def test_exact_top(spark):
    df, x = vectors(spark)
    m = np.vstack([np.floor(256 * x.astype(float)), np.zeros((2, 8))])
    want = brute_top(m, [*range(600), 601], 50, 5)
    got = {}
    for r in kd_trees.top(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    got.pop(605, None)
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}
    assert kd_trees.top(df.limit(0)).count() == 0


def test_forest_recall(spark, sf):
    df, x = vectors(spark)
    assert rp_forest.nearest(df.limit(0)).count() == 0
    rows = rp_forest.nearest(df).collect()
    want = brute_top(x.astype(float), list(range(600)), 20, 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert 600 not in got and 601 not in got
    assert np.mean([len(set(got[q]) & {i for i, _ in v}) / 20 for q, v in want.items()]) >= 0.9
    assert all(got[q][i] == pytest.approx(s, abs=1e-9) for q, v in want.items() for i, s in v if i in got[q])
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    m, ids = np.array([r.embedding for r in table], float), [r.vec_id for r in table]
    found = {}
    for r in queries.op2_neighbours(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i, q in enumerate(ids):
        if q % 20 == 0:
            s = m @ m[i]
            best = [ids[j] for j in np.lexsort((ids, -s)) if j != i][:20]
            hits.append(len(found[q] & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_ties_and_recall_over_several_shards(spark, monkeypatch):
    """Copies in all shards have equal scores and stand by id; odd columns and repeated ids; recall at 20,000 rows."""
    r = np.random.default_rng(5)
    x = r.standard_normal((20_000, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = list(range(40, 20_000, 333))
    x[copies] = x[40]
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in enumerate(x)]
    rows += rows[:50] + [(7, x[11].tolist(), 1, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, `rank` int, score string")
    asked = df.where("vec_id % 400 = 40 or vec_id % 20 <> 0")
    found = {}
    for row in rp_forest.nearest(asked).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert all([n for n, _ in enumerate(v, 1)] == list(range(1, 21)) for v in found.values()) and len(found) == 50
    # of its copies a query has the 20 least ids but its own, all with the same score
    assert [i for i, _ in found[40]] == [i for i in copies if i != 40 and (i % 400 == 40 or i % 20)][:20] and len({s for _, s in found[40]}) == 1
    m, hits = x.astype(float), []
    others = [i for i in range(20_000) if i % 400 == 40 or i % 20]
    for q, own in found.items():
        s = m[others] @ m[q]
        best = [others[j] for j in np.argsort(-s, kind="stable") if others[j] != q][:20]
        hits.append(len(set(best) & {i for i, _ in own}) / 20)
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in zip(own, own[1:]))
        assert all(s == pytest.approx(m[i] @ m[q], abs=1e-9) for i, s in own if i != 7)
    assert np.mean(hits) >= 0.9
    monkeypatch.setattr(kd_trees, "LEAF", 16)
    few = df.where("vec_id < 9000 and (vec_id % 500 = 0 or vec_id % 50 <> 0)")
    ints = np.floor(256 * m)
    got = {}
    for row in kd_trees.top(few).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    ids = [i for i in range(9000) if i % 500 == 0 or i % 50]
    for q in range(0, 9000, 500):
        s = {i: int(ints[i] @ ints[q]) for i in ids if i != q}
        s[7] = max(s[7], int(ints[11] @ ints[q]))  # an id that repeats has its best vector
        assert got[q] == sorted(s.items(), key=lambda p: (-p[1], p[0]))[:5]
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        kd_trees.top(big).collect()


def test_segmentations(spark, docs, odd):
    lattices = segmentations.Lattices.of(PIECE)
    rows = segmentations.sample(docs, PIECE, with_ids=True).collect()
    assert all(r.round_trip for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["rank"])
        assert len({tuple(r.ids) for r in own}) == len(own) and all(a.perturbed >= b.perturbed for a, b in zip(own, own[1:]))
    assert lattices.model.decode(rows[0].ids) == docs.where(F.col("doc_id") == rows[0].doc_id).first().text
    assert all(r.round_trip for r in segmentations.sample(odd, PIECE).collect()) and segmentations.sample(odd.limit(0), PIECE).count() == 0
    text = docs.limit(20)
    assert {r.doc_id: r.text for r in segmentations.decoded(segmentations.encode(text, PIECE), PIECE).collect()} == {r.doc_id: r.text for r in text.collect()}


def test_segmentations_follow_the_distribution():
    lattices, word = segmentations.Lattices.of(PIECE), "the then"

    def paths(w):
        out = []

        def walk(i, ids, total):
            if i == len(w):
                out.append((tuple(ids), total))
            for j in range(i + 1, min(len(w), i + 16) + 1):
                p = lattices.model.piece_to_id(w[i:j])
                if p and lattices.model.get_score(p) > -1e8:
                    walk(j, [*ids, p], total - math.log(2 - lattices.model.get_score(p)))

        walk(0, [], 0.0)
        return out

    weight = {a + b: math.exp(x + y) for a, x in paths("▁the") for b, y in paths("▁then")}
    p = {k: v / sum(weight.values()) for k, v in weight.items()}
    n, pairs = 6000, {}
    for at in range(0, n, 500):
        got = {}
        for d, _, ids, total, _, _ in segmentations.segmentations(lattices, [word] * 500, list(range(at, at + 500)), 2):
            got.setdefault(d, []).append(tuple(np.frombuffer(ids, "<u4").tolist()))
            assert math.exp(total) == pytest.approx(p[got[d][-1]], rel=1e-6)
        for a, b in got.values():
            pairs[a, b] = pairs.get((a, b), 0) + 1
    top = sorted(p, key=p.get, reverse=True)[:3]
    for a, b in itertools.permutations(top, 2):
        assert pairs.get((a, b), 0) / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)


@pytest.mark.parametrize("text", ["a   b", "   a", "a  \n   b", "a    "])
def test_segmentations_over_runs_of_spaces(text):
    """All segmentations of a text by enumeration, those with pieces of several spaces among them."""
    lattices = segmentations.Lattices.of(PIECE)
    m, w, p = lattices.model, "▁" + text.replace(" ", "▁"), {}

    def walk(i, ids, total):
        if i == len(w):
            p[tuple(ids)] = math.exp(total)
        for j in range(i + 1, len(w) + 1):
            piece = m.piece_to_id(w[i:j])
            if piece != m.unk_id():
                walk(j, [*ids, piece], total - math.log(2 - m.get_score(piece)))
            elif j == i + 1:
                raw = w[i:j].encode()
                walk(j, [*ids, *(m.piece_to_id(f"<0x{b:02X}>") for b in raw)], total - len(raw) * math.log(m.get_piece_size()))

    walk(0, [], 0.0)
    p = {k: v / sum(p.values()) for k, v in p.items()}
    own, n = tuple(m.encode(text)), 2000
    first = {}
    for _, rank, ids, total, _, _ in segmentations.segmentations(lattices, [text] * n, list(range(n)), 2):
        found = tuple(np.frombuffer(ids, "<u4").tolist())
        assert math.exp(total) == pytest.approx(p[found], rel=1e-6)
        if rank == 1:
            first[found] = first.get(found, 0) + 1
    top = max(p, key=p.get)
    assert own in p and first[top] / n == pytest.approx(p[top], abs=0.05)


def test_all_segmentations_of_a_short_text():
    """With k above their number: every one once, the masses left over exact (probabilities add up to 1), and no endless draws."""
    lattices = segmentations.Lattices.of(PIECE)
    for text in ("a", "an", "in a", "é", "你"):
        by = {}
        for d, _, ids, total, value, inclusion in segmentations.segmentations(lattices, [text] * 20, list(range(20)), 40):
            by.setdefault(d, []).append((ids, total, value, inclusion))
        for own in by.values():
            assert len({x[0] for x in own}) == len(own) == len(by[0]) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
            assert len(own) == 40 or sum(math.exp(x[1]) for x in own) == pytest.approx(1) and all(x[3] == 1 for x in own)
            assert all(segmentations.decode(lattices, np.frombuffer(x[0], "<u4")) == text for x in own)


def test_long_unbroken_texts(monkeypatch):
    """Words without a space have the same paths and probabilities window by window, and their lattice is never held as a whole."""
    lattices, r = segmentations.Lattices.of(PIECE), random.Random(2)
    word = "▁" + "".join(r.choice("thequickbrownfxé你") for _ in range(1500))
    monkeypatch.setattr(segmentations, "WINDOW", 64)
    wide, narrow = segmentations.Wide(lattices, word), segmentations.Narrow(lattices, word, {k: v[0] for k, v in lattices.build([word]).items()})
    assert wide.total == pytest.approx(narrow.total)
    for state in np.arange(10, dtype=np.uint64) * np.uint64(2**60 + 1):
        path = wide.path(state)
        assert path == narrow.path(state) and wide.ids(path).tolist() == narrow.ids(path).tolist() and wide.logp(path) == pytest.approx(narrow.logp(path))
    other = [wide.other([path, narrow.path(np.uint64(7))], np.random.default_rng(i)) for i in range(5)]
    assert path not in other
    monkeypatch.undo()
    text = "".join(r.choice("thequickbrownfx") for _ in range(60_000))
    build = segmentations.Lattices.build

    def small(self, words):
        assert len(words[0]) <= segmentations.LONG
        return build(self, words)

    monkeypatch.setattr(segmentations.Lattices, "build", small)
    rows = list(segmentations.segmentations(lattices, ["a b", text, "c " + text[:5000] + " d"], [1, 2, 3], 3))
    assert len(rows) == 9 and {segmentations.decode(lattices, np.frombuffer(ids, "<u4")) for d, _, ids, *_ in rows if d == 1} == {text}


def test_short_words_are_summed_without_exponentials(monkeypatch):
    """Words whose sums can't become too small take no exponential for each way into each place, and have the lattice that logarithms give."""
    lattices, exp, taken = segmentations.Lattices(PIECE), np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), exp(x, *a, **k))[1])
    for words in (["▁thequickbr", "▁éa你xxé你thé", "▁" * 11, "▁" + "😀" * 10], ["▁the", "▁and"], ["▁", "é"], ["😀" * 15]):
        lattices.plain = 16
        short = lattices.build(words)
        assert not taken
        lattices.plain = 0
        long = lattices.build(words)
        assert taken and (short["piece"] == long["piece"]).all()
        taken.clear()
        assert np.isfinite(short["forward"]).all() and np.allclose(short["forward"], long["forward"], rtol=1e-12) and np.allclose(short["share"], long["share"], rtol=1e-12)
    assert 16 == segmentations.Lattices(PIECE).plain


def labelled(spark, n=900):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(["bal", "dor", "fen", "gul", "hap", "jin", "kol"]) + str(r.randrange(50)) for _ in range(r.randint(30, 120))]
        bad, poor = i % 5 == 0, i % 4 == 0
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "vilex" + r.choice("abc"), "vilex" + r.choice("xyz")]))
        text = " ".join(words).upper() + "!!" * 20 if poor else " ".join(words).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not poor), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "target", "mod", "fold"), [(toxicity.score, "toxic", 3, 1), (quality.score, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, odd, score, target, mod, fold):
    docs, labels = labelled(spark)
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[target] for r in out]) > 0.97
    assert score(odd, labels).count() == len(odd_rows()) and score(odd, labels.limit(0)).count() == len(odd_rows())
    assert score(odd.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_pipeline_stages(spark, sf, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        out.collect()
        assert stage(spark, odd.limit(0), sf).count() == 0
    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(0 < r.length <= 4096 for r in rows)
