"""The training-data operators against brute force, exact round trips and held-out rows."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import ann, bpe, html_text, langid, mixing, near, pii, quality, queries, recipe, simhash, toxicity
from wayfold.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " \n\t ", None, "one", "one two", "A b C a B c a b c", "x" * 20_000, "w " * 30_000, "É ß\x1ca\x85b", "line a\nline a\n\nline b\nline a"]


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def odd_docs(spark):
    rows = [(k, t, "en", "src0", None) for k, t in enumerate(ODD)] + [(5, ODD[5], None, None, 1), (None, "a null id", "en", None, None), (None, None, None, None, None)]
    clash = ["fp", "component_id", "key", "fingerprint", "__tokens_", "words", "bucket", "score", "u", "v"]
    return spark.createDataFrame(rows, DOC).select("*", *(F.lit(1).alias(c) for c in clash))


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    items = sorted(prints.items())
    root = {k: k for k, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k, _ in items}


def test_simhash_against_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    prints = {k: slow_fingerprint(t) for k, t in texts.items()}
    roots = slow_components(prints)
    assert got == {k: (f"{p:016x}", roots[k]) for k, p in prints.items()}


def test_links_are_complete_up_to_three_bits(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                bits = rng.choice(64, n, replace=False)
                values.add(b ^ sum(1 << int(i) for i in bits))
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 160)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 150, 150: 150, 160: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(slow_components({k: slow_fingerprint(t) for k, t in texts.items()}).values()))
    odd = simhash.keep_one(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns
    assert odd.where("doc_id is null").count() == 1 and odd.where("doc_id in (0, 1, 2)").count() == 1


def test_keep_one_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    first, other = (" ".join(f"w{x}" for x in rng.integers(0, 5_000, 200)) for _ in range(2))
    rows = [(7, first, "en", "src0", None), (7, other, "en", "src0", None), (3, first, "en", "src0", None)]
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        docs = spark.createDataFrame(order, DOC).coalesce(1)
        assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(3, first), (7, other)]


def edited(words, every, k):
    return " ".join(f"edit{k}x{i}" if i % every == every - 1 else w for i, w in enumerate(words))


def test_near_copies_of_the_stage(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for group in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5_000, 400)]
        # One changed word in 50 leaves a similarity of about 0.82, one in 20 of 0.6.
        rows += [(10 * group, " ".join(words)), (10 * group + 1, edited(words, 50, 1)), (10 * group + 2, edited(words, 20, 2)), (10 * group + 3, " ".join(words).upper())]
        want |= {10 * group, 10 * group + 2}
    # Texts that share an id and are no near copies both stay; ids do not matter to the comparison.
    other = " ".join(f"v{x}" for x in range(300))
    rows += [(1, other), (5_000, other), (None, other)]
    text = {k: v for k, v in reversed(rows)}
    sets = {k: near.shingles(v) for k, v in text.items()}
    assert near.similarity(sets[10], sets[11]) >= 0.8 > near.similarity(sets[10], sets[12])
    docs = spark.createDataFrame([(k, v, "en", "src0", None) for k, v in rows], DOC)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert got == sorted([(k, text[k]) for k in want] + [(1, other)])
    again = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs.orderBy(F.desc("doc_id")), SF).collect())
    assert again == got


def test_near_copies_against_brute_force(spark, texts):
    sets = {k: near.shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    kept = sorted(r.doc_id for r in near.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert kept == sorted(set(root.values()))


def slow_base(text):
    words = WORDS.findall(text or "")
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in where.values() if len(at) > 1 for i in at for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_base_counts(spark, texts):
    model = [0.0] * quality.BUCKETS
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in quality.assess(docs, model).collect():
        assert tuple(r["__quality"][n] for n in names) == slow_base(texts[r.doc_id])
    for r in quality.assess(odd_docs(spark), model).collect():
        want = slow_base(r.text)
        assert tuple(r["__quality"][n] for n in names) == want
        assert r["__quality"].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_ratio_against_plain_counts(spark):
    rows = [(1, "good words go here often", None, None, None), (2, "bad ### words", None, None, None), (3, "good words", None, None, None)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, 1, 0), (3, 1, 0), (2, 0, 0)], LABEL)
    counts = {r.bucket: (r.raw, r.target) for r in quality.bucket_counts(docs, labels).collect()}
    assert sum(x for x, _ in counts.values()) == 2 * (5 + 3 + 2) and sum(x for _, x in counts.values()) == 2 * 7
    got = {r.doc_id: r["__quality"].ratio for r in quality.assess(docs, quality.fit(docs, labels)).collect()}
    assert got[2] < got[3] and got[1] > got[2]
    assert set(quality.fit(docs, labels.where("false"))) == {0.0}


def test_quality_keeps_good_and_drops_bad(spark):
    got = queries.op2_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] == 1.0 and share[0] < 0.05


def test_mixing_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, queries.op3_mix_sources(spark, SF).collect()))
    assert got == sorted(con.execute(queries.OP3_SQL).fetchall())


def test_mixing_budgets_and_shortages(spark):
    rows = [(k, "w " * 10, "en", s, None) for k, s in enumerate(["a"] * 2 + ["b"] * 50 + ["c"] * 50)]
    docs = spark.createDataFrame(rows, DOC)
    domain = F.when(F.col("source") == "c", "y").otherwise("x")
    got = mixing.mix(docs, domain, {("x", "en", "a"): 9.0}, 0.5, 2)
    taken = {r.source: r.t for r in got.groupBy("source").agg(F.sum("__taken").alias("t")).collect()}
    # Half of 1020 tokens, split evenly; a can give 40 and its sibling takes up the rest.
    assert taken == {"a": 40, "b": 215, "c": 255}
    assert mixing.mix(docs.where("false"), domain, {}, 0.5, 2).count() == 0
    odd = mixing.mix(odd_docs(spark), F.col("source"), {}, 1.0, 1)
    assert odd.where("trim(coalesce(text, '')) = ''").count() == 0 and set(odd_docs(spark).columns) <= set(odd.columns)


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = recipe.tokenizer_file()
    theirs = Tokenizer.from_file(path)
    ours = bpe.RankArrayBpe(open(path, "rb").read())
    many = [*texts.values(), *(t or "" for t in ODD), "a<|endoftext|>b", "日本語 🎉 café", "ab" * 700]
    for text in many:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == ids
        assert ours.decode(ours.encode(text)) == theirs.decode(ids, skip_special_tokens=False) == text
    got = {r.doc_id: r for r in bpe.encode_documents(odd_docs(spark).where("doc_id is not null"), path, with_ids=True).collect()}
    for k, text in enumerate(ODD):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids == ids and got[k].decoded == (text or "")
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_scan_equals_heap():
    ours = bpe.RankArrayBpe(open(recipe.tokenizer_file(), "rb").read())
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40, 150):
        for _ in range(20):
            piece = bytes(rng.choice(list(b"theandingr "), n))
            assert ours.merge_scan(piece) == ours.merge_heap(piece)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, sf)
    assert got.where("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").count() == 0
    assert got.where("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= 0.75 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.05 * n.get((0, 0), 0)


def test_toxicity_evidence(spark):
    rng = np.random.default_rng(10)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5_000, n))
    shared = draw(400)
    texts = [(y, f"{shared} {draw(400)}") for y in (0, 1) for _ in range(6)]
    copies = [(1, f"{t} more") for y, t in texts if y]
    got = [(r["__y"], r["__text"]) for r in toxicity.distinct_evidence(spark.createDataFrame(texts + copies + texts, "__y int, __text string")).collect()]
    # Of a text and its copy one may be left out; no text goes for a shared passage, nor under another label.
    assert len(got) == len(set(got)) and set(got) <= {*texts, *copies} and {t for t in texts if not t[0]} <= set(got)
    assert all(t in got or (1, f"{t[1]} more") in got for t in texts if t[0])
    pair = [(1, shared), (1, f"{shared} more")]
    assert toxicity.distinct_evidence(spark.createDataFrame(pair, "__y int, __text string")).count() == 1


def test_toxicity_edges(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (3, None, None)], LABEL)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.words == {} and toxicity.classify(docs, model).count() == docs.count()


def test_surrogates_hold_type_format_and_distinctness():
    keyed = pii.Surrogates("k")
    phones = {f"+1 (212) 555-{i:04d}" for i in range(500)}
    fresh = {keyed.structured("phone", p) for p in phones}
    assert len(fresh) == 500 and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p) for p in fresh)
    cards = {"4111111111111111", "4041894974608795", "4111 1111 1111 1112"}
    for card in cards:
        other = keyed.structured("card", card)
        bare = lambda x: x.replace(" ", "")
        valid = lambda x: pii.luhn(bare(x)[:-1]) == int(bare(x)[-1])
        assert other != card and other[0] == card[0] and len(other) == len(card) and valid(other) == valid(card)
    small = [keyed.permute(v, 97, "t") for v in range(97)]
    assert sorted(small) == list(range(97))


def test_surrogates_in_text():
    keyed = pii.Surrogates("k")
    text = "Mr. John Smith (a.b@mail.example.com) met Mrs. Mary Smith. Mr. John Smith left 10.0.0.1, password=abc12345"
    out, found = pii.anonymise(text, keyed)
    assert all(e.value not in out for e in found if e.kind != "name")
    names = {e.value: e.surrogate for e in found if e.kind == "name"}
    assert set(names) == {"John", "Smith", "Mary"} and len(set(names.values())) == 3
    assert out.count(names["John"]) == 2
    assert pii.anonymise("nothing here at all", keyed) == ("nothing here at all", [])
    assert pii.anonymise(text, pii.Surrogates("other"))[0] != out


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Smith came. Mr. John Smith spoke, then Smith said that John's hat was Smith's.", "John Smith"), ("Frau Dr. Muller kam. Muller ging.", "Muller"),
        ("Prof. Dr. Muller", "Muller"), ("Mr. J. Smith and Mr J R Brown", "Smith Brown"), ("Mr. John Q. Adams", "John Adams"),
        ("Señor Don Juan Perez", "Juan Perez"), ("Mr. Don Johnson", "Don Johnson"), ("Herr Prof. Dr. Karl-Heinz Bauer", "Karl-Heinz Bauer"),
    ],
)
def test_surrogates_of_every_mention(text, names):
    out, found = pii.anonymise(text, pii.Surrogates("k"))
    assert {e.value for e in found} == set(names.split())
    fresh = {e.value: e.surrogate for e in found}
    assert out == re.sub(rf"\b(?:{'|'.join(names.split())})\b", lambda m: fresh[m[0]], text)


def test_surrogate_rows(spark):
    odd = odd_docs(spark)
    got = pii.replace_documents(odd, "k", with_entities=True)
    assert got.columns == [*odd.columns, "__entities"]
    assert sorted(map(repr, got.select("text").collect())) == sorted(map(repr, odd.select("text").collect()))


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    docs = odd_docs(spark)
    model = langid.fit(docs, F.lit(True))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (0, 1, 2))
    assert langid.identify(docs, {}).where("lang_pred != 'und'").count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<head><title>t</title></head><div>x</div><script>y</script><p hidden>z</p><i style='display: none'>w</i>", "x"),
        ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"), ("<pre>a\n  b</pre>", "a\n  b"), ("a &amp; b&nbsp;c", "a & b\xa0c"),
        ("<b>unclosed <i>tags", "unclosed tags"), ("</p></div>x", "x"), ("<details><summary>s</summary>gone</details>", "s"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><td>a</td><td>b</table>", "a  b"), ("<table>x<tr>y<td>a</table>", "xy\n\na"), ("<table><tr><div>text</div></tr></table>", "text"),
        ("<table><tr><td>a<tr><div>d<tr><td>b</table>", "d\n\na\nb"), ("<table><form><tr><td>a<td>b</form></table>", "a  b"), ("<p aria-hidden='true'>seen</p>", "seen"),
        ("<table><tbody><td>a<tbody><td>b</table>", "a\nb"), ("<table><tbody><tr><td>a</tbody><td>b</table>", "a\nb"), ("<table><tr><td><div>x<table><td>y</table></table>", "x\ny"),
        ("<table><thead><th>h</thead><tr><td>a</table>", "h\na"), ("<table><tr hidden><td>a</tr><td>b</table>", "b"),
    ],
)
def test_html_tables_lose_no_text(html, text):
    assert html_text.extract(html) == text


def test_html_depth_and_rows(spark):
    assert html_text.extract("<div>" * 20_000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(str(r.text) for r in html_text.extract_pages(pages).collect()) == ["None", "a", "a"]


def test_neighbours_recall_and_exact_scores(spark):
    got = queries.op10_nearest_neighbours(spark, SF)
    rows = dict(duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall())
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids], dtype=np.float64)
    found, hits, total = {}, 0, 0
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in rows if i % 20 == 0}
    for q, near in found.items():
        score = matrix @ np.array(rows[q], dtype=np.float64)
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21))
        assert all(abs(s - score[np.searchsorted(ids, i)]) < 1e-12 for _, i, s in near)
        hits, total = hits + len({i for _, i, _ in near} & set(best)), total + 20
    assert hits >= 0.97 * total


def neighbour_recall(spark, vectors):
    """Recall at 20 of every 20th id, (vec_id, vector) rows searched against brute force; repeated ids count once."""
    ids, matrix = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>").coalesce(1)
    found = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        score = matrix @ matrix[np.argmax(ids == q)]
        best = [*dict.fromkeys(int(i) for i in ids[np.lexsort((ids, -score))] if i != q)][:20]
        hits, total = hits + len(found.get(q, set()) & set(best)), total + len(best)
    return hits / total


def test_neighbours_recall_at_any_norm(spark):
    rng = np.random.default_rng(3)
    drawn = rng.standard_normal((2_000, 64))
    drawn /= np.linalg.norm(drawn, axis=1)[:, None]
    for norm in (0.01, 1.0, 100.0):
        scaled = [(i, v * (norm if i % 20 == 0 else 1.0)) for i, v in enumerate(drawn)]
        assert neighbour_recall(spark, scaled) >= 0.97, norm


def test_neighbours_recall_with_repeated_ids(spark):
    rng = np.random.default_rng(4)
    drawn = rng.standard_normal((600, 64))
    drawn /= np.linalg.norm(drawn, axis=1)[:, None]
    for copies in (3, 5):
        assert neighbour_recall(spark, [(i, v) for i, v in enumerate(drawn) for _ in range(copies)]) >= 0.97, copies
    # A query's own copies, more than k of them, must not set the bar.
    assert neighbour_recall(spark, [(i, v) for i, v in enumerate(drawn) for _ in range(30 if i % 20 == 0 else 1)]) >= 0.97


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (20, [float("inf"), 0.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 8, 1.0)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == columns, name
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert all(stage(spark, docs.where("false"), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_clashing_columns_pass_through(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    clash = ["fp", "root", "node", "kept", "n_tokens", "__tokens", "__domain", "__lang", "__order", "__bin", "__l", "__n", "__text", "__quality", "__epochs", "__taken", "___row", "c0"]
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    altered = " or ".join(f"{c} is null or {c} != {k}" for k, c in enumerate(clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.where(altered).count() == 0 and got.count() > 0, name
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).count() == docs.count()
    assert toxicity.classify(docs, toxicity.fit(docs, labels, F.lit(True))).count() == docs.count()
    assert "array" in dict(pii.replace_documents(docs.withColumn("__entities", F.lit(1)), "k", with_entities=True).dtypes)["__entities"]


def test_stages_with_nulls_everywhere(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.unionByName(empty), SF).count() >= stage(spark, docs, SF).count() > 0, name
