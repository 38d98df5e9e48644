"""Near-duplicates, trained operators, encoding and extraction."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loanspan.llm import bpe, extract, langid, neardup, pii, queries, toxicity
from loanspan.llm.common import tokenizer_path
from loanspan.llm.shingles import MinHash, WordHashes, set_id, shingle_set, similar
from tests.conftest import SF
from tests.llm.conftest import documents


def groups(rows, n):
    """Smallest reachable id of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 10)
    monkeypatch.setattr(neardup, "HOME_SETS", 40)
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(random.integers(0, 7)):
            words[random.integers(0, 120)] = f"v{i}x{random.integers(0, 99)}"
        texts.append(" ".join(words))
    texts += ["Two words", "two WORDS", "other words", "", None, texts[0], " ".join(base[:100]), "é É"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in neardup.similar_groups(docs, n=4).collect()}
    expected = groups(list(enumerate(texts)), 4)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in rows.items())


@pytest.mark.parametrize("small, home_sets", [(2, 25), (16, 500)])
def test_a_large_group_of_copies_below_the_threshold(spark, monkeypatch, small, home_sets):
    """Most copies of one text are 0.6 to 0.8 alike, and few of them are linked."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "HOME_SETS", home_sets)
    random = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(260):
        words = list(base)
        for place in random.choice(150, random.integers(3, 9), replace=False):
            words[place] = f"v{i}x{place}"
        texts.append(" ".join(words))
    rows = {r["doc_id"]: r for r in neardup.similar_groups(documents(spark, texts), n=4).collect()}
    expected = groups(list(enumerate(texts)), 4)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == expected
    assert 1 < len({c for _, c in expected.values()}) < 260


def test_links_of_blocks_join_components_only():
    random = np.random.default_rng(2)
    known, sign = WordHashes(), MinHash(128)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        words = list(base)
        for place in random.choice(60, random.integers(0, 5), replace=False):
            words[place] = f"v{i}x{place}"
        texts.append(" ".join(words))
    sets = {set_id(x): (x, t) for t in texts for x in [shingle_set(t, 3, known)]}
    rows = [(sid, i % 2, sid if i % 5 else 0, t) for i, (sid, (_, t)) in enumerate(sets.items())]
    # A row whose text is another one's, and a row that comes twice.
    block = neardup._Block([*rows, rows[0], (rows[1][0], 1, 0, "other words")], 3, known, sign)
    links = block.links(80, 60)
    assert 0 < len(links) < len(rows)

    def parts(joined):
        root = {r[0]: r[2] for r in rows}
        for a, b in joined:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))

    true = [
        (a[0], b[0]) for a in rows if not a[1] for b in rows if b[1]
        if similar(sets[a[0]][0], sets[b[0]][0], 80)
    ]
    assert parts(links) == parts(true)
    assert all(similar(sets[a][0], sets[b][0], 80) for a, b in links)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = neardup.similar_groups(odd).collect()
    assert len(rows) == 10
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert neardup.similar_groups(none).count() == 0
    kept = neardup.deduplicated(odd)
    # One of the repeated rows goes, and the copy without id.
    assert kept.columns == odd.columns and kept.count() == 8


def test_near_duplicates_are_judged_by_row(spark):
    a, b = ("one two three four five six seven", "red green blue black white grey pink")
    rows = [(5, b), (3, a), (5, a), (5, b), (None, a), (None, "x y z"), (None, "x y z"), (None, ""), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("row", "id", "doc", "group", "__dropped", "__leaked")]
    )
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key)
    assert found == sorted([(3, a), (5, b), (9, None), (None, "x y z"), (None, ""), (None, "")], key=key)


def test_language_samples_are_bounded(spark):
    words = F.concat_ws(" ", *[F.md5((F.col("id") * 7 + i).cast("string")) for i in range(3)])
    table = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).cast("bigint").alias("doc_id"),
        F.when(F.col("id") % 5 > 0, words).otherwise("hot text").alias("text"),
        F.lit("en").alias("lang"),
    )
    seen = []
    original = langid.fit
    langid.fit = lambda counts, languages: seen.append(len(languages)) or original(counts, languages)
    try:
        langid.train(table)
        langid.train(table.withColumn("lang", F.concat("lang", (F.xxhash64("text") % 100).cast("string"))))
    finally:
        langid.fit = original
    assert seen[0] == langid.TRAIN_DOCS_PER_LANGUAGE
    assert 0 < seen[1] <= langid.TRAIN_DOCS


def test_components_of_a_chain(spark):
    from loanspan.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_language(spark, small, odd, none):
    model = langid.train(small)
    rows = langid.identify(small, model).collect()
    right = [r["lang"] == r["lang_pred"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean(right) >= 0.95 and sum(r["rejected"] for r in rows) <= 2
    found = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert len(found) == 9 and all(found[i]["lang_pred"] == "und" for i in (0, 1, 2))
    text = documents(spark, ["Привет, как дела? Всё хорошо.", "12 34"])
    assert all(r["rejected"] for r in langid.identify(text, model).collect())
    assert langid.query(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    # Labels of held-out rows change nothing.

    other = small.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert np.array_equal(langid.train(other).centroids, model.centroids)


def test_languages_never_learned_are_rejected(spark, small):
    random = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = [" ".join("".join(random.choice(letters, random.integers(2, 10))) for _ in range(60)) for _ in range(50)]
    for left_out in ("de", "fr", "es", "en"):
        model = langid.train(small.filter(f"lang <> '{left_out}'"))
        rows = langid.identify(small, model).collect()
        assert np.mean([r["rejected"] for r in rows if r["lang"] == left_out]) >= 0.9
        assert np.mean([r["rejected"] for r in rows if r["lang"] != left_out]) <= 0.02
        assert all(r["rejected"] for r in langid.identify(documents(spark, junk), model).collect())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


ODD_TEXTS = [
    "Hello THE them's don't <|endoftext|>x<|startoftext|> <|endofText|>", "é É ΑΣ ΟΔΟΣ İstanbul 12½ ⅷ",
    "日本語 🙂🙂!! \x1c\x85a\xa0b​c　d'RE ''s", "", "\n", "ǅ ﬁ ß ẞ", "ab" * 3000, "a\x00b",
]


def test_encoding_equals_the_library(spark, small, odd, none, tokenizer):
    docs = documents(spark, ODD_TEXTS)
    for table in (docs, odd, small):
        for r in bpe.encoded(table, tokenizer_path(), size=500).collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.query(none, tokenizer_path()).count() == 0
    row = bpe.query(docs, tokenizer_path()).filter("doc_id = 0").first()
    ids = tokenizer.encode(ODD_TEXTS[0], add_special_tokens=False).ids
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_transducer_shares_suffixes():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "a", ""])}
    found = bpe.Transducer.mapped(bpe.Transducer.compile(words).to_bytes())
    asked = [*words, b"ta", b"tapsx", b"b", b"x" * 100]
    assert [None if r is None else r.tolist() for r in found.lookup(asked)][:5] == [words[w] for w in asked[:5]]
    assert all(r is None for r in found.lookup(asked)[6:])
    assert len(found.arrays["final"]) == 5  # root, t, ta = to, tap = top, tops = a


def plain_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    expected = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    rows = extract.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_extraction_learns_a_template(spark):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>We use</div>"
        "<div id=sidebar><p>side</p></div><div class=body-text><h2>Head &amp; {0}</h2><p>One <b>tw</b>o<br>three &nbsp; "
        "{1}<div class='ad box'>buy</div><ul><li>a<li>b</ul><form>Name</form><div class=comments><p>nice {1}</p></div></div>"
        "<div class=teaser><p>tail</p></div><footer>f</footer><script>x='</div>'</script></body></html>"
    )
    rows = [(i, "https://Example.org/a", page.format(i, "word " * (30 + i)), 1, 2) for i in range(6)]
    rows += [(6, None, None, 1, 2), (None, "x", "", 1, 2), (8, "//b.c", "<p>free <i>t</i>ext", 1, 2), (8, "//b.c", "<p>free <i>t</i>ext", 1, 2), (9, "http://z/", "<div" * 2000 + "<!-- <p>", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, container int")
    found = extract.extract(pages).collect()
    assert len(found) == 11
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[3] == "Head & 3 One two three " + " ".join(["word"] * 33) + " a b"
    assert by_id[6] == "" and by_id[None] == "" and by_id[8] == "free text"
    assert extract.extract(pages.limit(0)).count() == 0


def test_extraction_keeps_frames_and_articles_with_listed_words(spark):
    text = "<h2 id='related-work'>Related</h2><p>Long {0} " + "words " * 40 + "</p><section id='search-{1}'><p>Trees {0}</p></section>"
    frames = [
        "<body class='has-sidebar'>" + text + "</body>",
        "<body><article class='post comments-open'>" + text + "</article></body>",
        "<body><main class='with-sidebar'>" + text + "</main></body>",
        "<body><form><div>" + text + "</div></form></body>",
        "<body><div class='sidebar-layout'>" + text + "</div><div class='ad box'>buy</div></body>",
        "<body class='fixed-header'><div class='notice'>" + text + "</div><div class=share>s</div></body>",
    ]
    rows = [(10 * f + i, f"http://h{f}/{i}", frame.format(i, "abc"[i] * 3)) for f, frame in enumerate(frames) for i in range(3)]
    rows += [(100 + f, f"http://one{f}/", frame.format(0, "algorithms")) for f, frame in enumerate(frames)]
    # On one host, blocks of listed words among others: a template's, and one page's own.
    rows += [
        (200 + i, "http://t/", f"<body><div class=text><p>Long {i} {'words ' * 40}</p><div class='post-comments'>nice {i}</div>"
         + ("<div id='share-prices'>Prices</div>" if i == 2 else "") + "</div></body>") for i in range(5)
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    words = " ".join(["words"] * 40)
    for i, text in found.items():
        n = i % 10 if i < 100 or i >= 200 else 0
        expected = f"Related Long {n} {words} Trees {n}" if i < 200 else f"Long {n} {words}" + " Prices" * (n == 2)
        assert text == expected, i


def test_extraction_leaves_out_the_text_of_the_site(spark):
    page = (
        "<body><article><h1>News</h1><p>Story {0} begins {1}</p><div>Follow us on <a href=/x>our channel</a></div>"
        "<p>Shared line.</p><p>Shared line.</p>{2}<div><p>Text under  the <i>open</i> licence</p></div></article></body>"
    )
    rows = [(i, "http://s/", page.format(i, "word " * 30, "<p>Shared line.</p>" * (i % 2))) for i in range(6)]
    # Copies of one page, and a host of few pages, lose nothing.
    rows += [(10 + i, "http://copies/", page.format(7, "word " * 30, "")) for i in range(6)]
    rows += [(20 + i, "http://few/", page.format(i, "word " * 30, "")) for i in range(3)]
    found = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    words = " ".join(["word"] * 30)
    for i, text in found.items():
        shared = " ".join(["Shared line."] * (2 + (i % 2 if i < 10 else 0)))
        if i < 10:
            assert text == f"News Story {i} begins {words} {shared}", i
        else:
            assert text == f"News Story {7 if i < 20 else i % 10} begins {words} Follow us on our channel {shared} Text under the open licence", i


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
]


def pii_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}" for kind, pattern, passes in PII for m in re.finditer(pattern, text)
        if passes(m.group(), re.sub("[^0-9]", "", m.group()))
    ]


def test_personal_data(spark, small, odd, none):
    model = pii.train(small)
    texts = [
        "a@b.c_d@e.f @x.y a@@b.c x%y@z-z.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1..2.3.4", "4111 1111 1111 1111-2",
        "é +1 (415) 555-0199 +12 +1+2345678", "call 415-555-0199 now", "in 2019-04-05 we had 1234567 items", "9" * 5000,
        "write to john (at) mail.com",
    ]
    for docs in (documents(spark, texts), odd, small):
        for r in pii.detect(docs, model).collect():
            expected = pii_spans(r["text"] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
            assert set(expected) <= set(filter(None, r["spans"].split(",")))
            assert r["n_ip"] == sum(x.startswith("ip") for x in expected)
    found = {r["doc_id"]: r["spans"] for r in pii.detect(documents(spark, texts), model).collect()}
    assert found[4] == "number_like:5:17" and found[5] == "" and found[7] == "mail_like:9:27"
    assert pii.query(none).count() == 0


def test_personal_data_commoner_than_the_fixed_formats(spark):
    random = np.random.default_rng(4)
    number = lambda n: "".join(map(str, random.integers(0, 10, n)))
    accounts, texts = [], []
    for i in range(400):
        bare = number(18)
        accounts.append(f"DE{98 - int(bare + '131400') % 97:02d}{bare}")
        phone = f"{number(3)}-{number(3)}-{number(4)}"
        texts.append(f"call {phone} now, or account {accounts[-1]} today, see page {number(8)} there")
        if i % 8 == 0:
            texts[-1] += f", write to a{i}@mail.com or phone +1 415 555 {number(4)}"
    docs = documents(spark, texts)
    rows = pii.detect(docs, pii.train(docs)).collect()
    found = {r["doc_id"]: r["spans"] for r in rows}
    phones = ["number_like:5:17" in found[i] for i in range(400)]
    ibans = [f"account_like:{t.index('DE')}:{t.index('DE') + 22}" in found[i] for i, t in enumerate(texts)]
    pages = [f"number_like:{t.index('page') + 5}:" in found[i] for i, t in enumerate(texts)]
    assert np.mean(phones) >= 0.95 and np.mean(ibans) >= 0.95 and np.mean(pages) <= 0.05


def test_toxicity(spark, small, odd, none):
    random = np.random.default_rng(1)
    words = ["river", "stone", "market", "winter", "garden", "letter", "window", "summer"]
    bad = ["grumbot", "snarfel", "blixing"]
    texts, marks = [], []
    for i in range(600):
        text = list(random.choice(words, 40))
        if i % 6 == 0:
            for j in random.choice(40, 4, replace=False):
                text[j] = str(random.choice(bad))
        texts.append(" ".join(text))
        marks.append(int(i % 6 == 0))
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(marks)) + [(None, 1), (5, None), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = [r for r in toxicity.query(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in rows]) >= 0.97
    assert model.score(toxicity.subwords("grumb0t snarfell river blixxing grumbots")) > 0.5
    assert model.score(toxicity.subwords(None)) < toxicity.THRESHOLD
    found = toxicity.scores(odd, model).collect()
    assert len(found) == 10 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.query(none, labels.limit(0)).count() == 0
    assert toxicity.query(odd, labels.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_training_is_bounded(spark, monkeypatch):
    """Repeated ids and many labels leave at most TRAIN_DOCS bags, one for each id."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 50)
    ids = [4] * 3000 + list(range(400))
    docs = documents(spark, [f"text number {i} of {d}" for i, d in enumerate(ids)], ids)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, marks: fitted.append((len(bags), sum(marks))))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels.filter("doc_id = 4"))
    assert fitted[0][0] == 50 and 0 < fitted[0][1] < 50 and fitted[1][0] <= 1


def test_pipeline(spark, small, odd, tokenizer):
    """Every stage on what the one before kept, and the ids of what is left."""
    from loanspan.llm.common import written

    docs, kept = small, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == small.columns
        if name == "near_dedup":
            expected = groups([tuple(r) for r in before.select("doc_id", "text").collect()], 5)
            assert kept[-1] == {d for d, (_, least) in expected.items() if least == d}
    assert all(a >= b for a, b in zip(kept, kept[1:], strict=False)) and len(kept[0]) >= small.count() - 2
    for r in docs.join(before.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == tokenizer.encode(r["text"], add_special_tokens=False).ids
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == kept[-1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)
