"""WARC archives, HTML extraction, toxicity models and the pipeline."""

import hashlib
import zlib

import zstandard

import corpus_pipeline
from tessera.llm import htmltext, toxicity, warc
from tessera.session import scratch_path
from tests.llm import helpers as H

PAGES = "page_id long, url string, html string"


def test_archive_round_trip_in_memory():
    records = [warc.record_bytes(k, f"http://x/é\n{k}", f"payload {k % 7} ".encode() * (k + 1),
                                 hashlib.sha256(f"payload {k % 7} ".encode() * (k + 1)).hexdigest(), "response", None)
               for k in range(200)]
    frames = list(warc.archive_frames(iter(records)))
    assert frames[0][:4] == (0x184D2A5D).to_bytes(4, "little") and len(frames) == 201
    data = warc.SEPARATOR.encode("latin-1").join(frames)
    assert list(warc.read_archive(data)) == records
    parsed = [warc.parse_record(r) for r in warc.read_archive(data)]
    assert parsed[3]["url"] == "http://x/é\n3" and parsed[3]["payload"] == b"payload 3 " * 4
    # any record can be read alone, given the dictionary
    d = zstandard.ZstdCompressionDict(frames[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=d).decompress(frames[150]) == records[149]
    assert list(warc.archive_frames(iter([]))) == []


def test_archives_keep_payloads_and_revisits(spark):
    big, rows = "<p>é" + "x" * 200, []
    rows += [(5, "http://a", big), (3, None, big), (9, "u", big), (4, "u", "small"), (2, "u", "small"), (7, "u", None),
             (8, "u", ""), (3, None, big), (None, "n", big), (None, "n", "y" * 150)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", H_lit("x"))
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    out = warc.read_archives(spark, path).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, u, t in rows:
        later = t == big and i != 3
        want.append((str(i), u, len((t or "").encode()), sha(t), "revisit" if later else "response", 3 if later else None,
                     None if later else (t or "").encode()))
    got = [(str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def H_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_archive_of_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES), scratch_path(spark, "warc-empty")).count() == 0


def test_archive_files_are_whole_zstd_streams(spark):
    path = scratch_path(spark, "warc-files")
    pages = H.table(spark, "pages")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    raw = sum(len(r.html.encode()) for r in pages.collect())
    assert sum(len(f.content) for f in files) < raw / 2
    texts = {r.page_id: r.html.encode() for r in pages.collect()}
    back = {r.page_id: r.payload for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert all(bytes(v) == texts[k] for k, v in back.items())


def test_archives_roll(spark):
    """Every archive starts with its own dictionary, holds little more than the bound and reads alone."""
    path = scratch_path(spark, "warc-roll")
    pages = H.table(spark, "pages", "/root/testdata/sf0.01")
    raw = sum(len(r.html.encode()) for r in pages.select("html").collect())
    bound = raw // 12
    warc.write_archives(pages.coalesce(1), path, bound)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    longest = max(len(r.html.encode()) for r in pages.select("html").collect()) + 1000
    assert len(files) >= 5
    for f in files:
        assert bytes(f.content[:4]) == (0x184D2A5D).to_bytes(4, "little")
        assert sum(map(len, warc.read_archive(bytes(f.content)))) <= bound + longest
    back = {r.page_id: (r.payload_digest, r.record_type) for r in warc.read_archives(spark, path).collect()}
    want = {r.page_id: (r.payload_digest, r.record_type) for r in warc.with_record_types(pages).collect()}
    assert back == want


def test_rolled_archives_in_memory():
    records = [bytes([k]) * (k % 5) for k in range(100)]
    for bound in (1, 7, 1000):
        frames = {}
        for archive, place, frame in warc.rolled(iter(records), bound):
            assert place == len(frames.setdefault(archive, []))
            frames[archive].append(frame)
        data = [warc.SEPARATOR.encode("latin-1").join(x) for x in frames.values()]
        assert [r for d in data for r in warc.read_archive(d)] == records
    assert list(warc.rolled(iter([]), 5)) == []


def test_main_text_of_driver_pages(spark):
    import html as ht
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", page, re.S)[1]
        return " ".join(ht.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())

    pages = H.table(spark, "pages", "/root/testdata/sf0.01")
    out = htmltext.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(out) == 250
    assert all(r.text == article(r.html) and r.n_chars == len(r.text) for r in out)


def test_main_text_of_varied_pages():
    long = "This paragraph is long enough to stand out among the short lines of a page. " * 2
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="page header"><header><h1>Site</h1></header>
<ul class="mainMenu"><li><a href=1>One</a></li></ul><div class="cookie-notice">{long}</div>
<div id="wrap"><aside><p>{long}</p></aside><div id="content"><h2>Head &amp; line</h2><p>{long}<p>Very <i>sh</i>ort.<br>x
<div class="advert"><p>{long}</div><ul><li>a point<li>next</ul><form><label>Name</label></form><p>Last&#33;</div>
<section id="comments"><article class="comment"><p>{long}</p></article></section></div>
<div><a href=a>{long}</a></div><script>if (a < b) "</p>"</script><footer>&copy; me</body></html>"""
    want = f"Head & line {long.strip()} Very short. x a point next Last!"
    assert htmltext.extract(page) == " ".join(want.split())
    assert htmltext.extract("a<b>b</b>c<br>d") == "abc d"
    assert htmltext.extract("<nav>x</nav>") == htmltext.extract("") == htmltext.extract(None) == ""
    assert htmltext.extract("<article><p>" + "y" * 50_000 + "</article>") == "y" * 50_000


def test_main_text_in_child_containers():
    """Sections, a div per paragraph, lists and tables of an article, next to long paragraphs."""
    long = " ".join(["This paragraph is long enough to stand out among the short lines of a page."] * 8)
    inner = f"""<section><h2>First</h2><div><p>{long}</p></div><div><p>Short one.</p></div><div><div><p>Deep.</p></div></div></section>
<section><h2>Second</h2><ul><li>a point<li>next</ul><table><tr><td>cell</td><td>2</td></tr></table></section>
<div class="share">Share</div><ul><li><a href=a>A link elsewhere</a></ul><div><p>{long}</p></div><div><p>End.</p></div>"""
    want = f"First {long} Short one. Deep. Second a point next cell 2 %s{long} End."
    page = "<body><div>Slogan</div>%s<div>Imprint line</div></body>"
    assert htmltext.extract(page % f"<article>{inner}</article>") == want % "A link elsewhere "
    assert htmltext.extract(page % f"<main><div>{inner}</div></main>") == want % "A link elsewhere "
    assert htmltext.extract(page % f"<div>{inner}</div>") == want % ""


def test_main_text_beside_strays_and_odd_names():
    """A policy bar without a telling name; sections of an article named like boilerplate; an
    article's list of sources; a second article of short lines."""
    long = " ".join(["This paragraph is long enough to stand out among the short lines of a page."] * 4)
    story = f"<div class=story><h1>Head</h1><p>{long}</p><p>{long}</p><p>Short end.</p></div>"
    page = f"<body><div class=bar>We set small files to remember what you like and for nothing else at all, read our policy on it.</div>{story}<div>Contact</div><div>Weather <b>today</b></div>"
    assert htmltext.extract(page) == f"Head {long} {long} Short end."
    body = f"""<h1>T</h1><p>{long}</p><section class="social-history"><p>{long}</p></section><div id="share-prices"><p>Prices rose.</p></div>
<div class="related"><p>{long}</p></div><div class="social share"><a href=a>Post it</a></div><div class="related-links"><ul><li><a href=a>{long}</a></ul></div>
<h2>Sources</h2><ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul><div class="comment-list"><p>{long}</p></div>"""
    want = f"T {long} {long} Prices rose. {long} Sources First source Second source"
    assert htmltext.extract(f"<body><nav>menu</nav><article>{body}</article><footer>f</footer>") == want
    second = "<article><h2>Brief</h2><p>All is well.</p></article>"
    assert htmltext.extract(f"<body><article>{body}</article>{second}<div>Imprint</div>") == want + " Brief All is well."


def test_main_text_edges(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (None, "u", "<p>x")]
    out = htmltext.main_texts(H.with_clashing_columns(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "", 0), ("None", "x", 1), ("None", "x", 1)]
    assert htmltext.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (H.table(spark, n, "/root/testdata/sf0.1") for n in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in out)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in out)
    assert hit / sum(r.predicted for r in out) > 0.9 and hit / sum(r.toxic for r in out) > 0.8


def test_toxicity_learns_no_held_out_label(spark):
    docs, labels = (H.table(spark, n, "/root/testdata/sf0.01") for n in ("documents", "labels"))
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score_toxicity(docs, labels).collect()) == sorted(toxicity.score_toxicity(docs, flipped).collect())


def _small_corpus():
    import random
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(120):
        toxic = k % 3 == 0
        pool = "bad worse awful you are".split() if toxic else "good kind you are here".split()
        rows.append((k, " ".join(rng.choice(pool + "a b c".split()) for _ in range(rng.randrange(1, 9)))))
        labels.append((k, 1, int(toxic)))
    return rows + [(500, None), (501, "never seen words"), (502, "You are, bad. bad you ARE here")], labels


def _brute_models(rows, labels):
    """Kneser-Ney by dictionaries: word and bigram probabilities of both classes."""
    from collections import Counter, defaultdict
    text = dict(rows)
    train = [(text[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    held, after, total = ([Counter(), Counter()] for _ in range(3))
    kinds = [defaultdict(set), defaultdict(set)]
    docs, single = [0, 0], [Counter(), Counter()]
    for t, y in train:
        ws = toxicity.words(t)
        docs[y] += 1
        single[y].update(set(ws))
        held[y].update(set(zip([None, *ws], ws)))
    for y in (0, 1):
        for (u, w), n in held[y].items():
            after[y][w] += 1
            total[y][u] += n
            kinds[y][u].add(w)
    every = Counter(w for _, t in rows for w in toxicity.words(t))
    share = {w: n / sum(every.values()) for w, n in every.items()}
    d = toxicity.DISCOUNT

    def p(y, w):
        k = sum(after[y].values())
        return (max(after[y][w] - d, 0) + d * len(after[y]) * share[w]) / k

    def q(y, u, w):
        m = total[y][u]
        return (max(held[y][u, w] - d, 0) + d * len(kinds[y][u]) * p(y, w)) / m if m else p(y, w)

    def evident(n0, n1):
        e = (n0 + n1) * docs[1] / sum(docs)
        return abs(n1 - e) > toxicity.EVIDENCE * (e + 1) ** 0.5

    def ratio(t):
        import math
        ws, out = toxicity.words(t), []
        for u, w in zip([None, *ws], ws):
            r = math.log(p(1, w) / p(0, w)) if evident(single[0][w], single[1][w]) else 0.0
            if evident(held[0][u, w], held[1][u, w]):
                r = math.log(q(1, u, w) / q(0, u, w))
            out.append(r)
        return sum(out) / len(out) if out else 0.0
    return p, q, ratio, every, total


def test_toxicity_models_sum_to_one_and_score_by_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(toxicity, "EVIDENCE", 1.0)
    rows, labels = _small_corpus()
    docs = H.documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = toxicity.count_expressions(docs, toxicity.training_rows(table, False))
    models = toxicity.word_models(counts, docs).cache()
    p, q, ratio, every, total = _brute_models(rows, labels)
    sums = models.agg(F.sum("p0"), F.sum("p1"), F.count("*")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9 and sums[2] == len(every)
    hashes = toxicity.WordHashes()
    key = {w: int(toxicity.word_hashes(w.decode(), hashes)[0]) for w in every}
    key[None] = 0
    got = {r.w: (r.p0, r.p1) for r in models.collect()}
    assert all(abs(got[key[w]][y] - p(y, w)) < 1e-12 for w in every for y in (0, 1))
    # every pair of a context: what follows it sums to one in each class
    n = {(r.u, r.w): (r.n0, r.n1) for r in counts.where("u is not null").collect()}
    contexts = [u for u in ({None} | set(every)) if total[0][u] and total[1][u]]
    pairs = [(key[u], key[w], *n.get((key[u], key[w]), (0, 0))) for u in contexts for w in every]
    made = toxicity.bigram_models(counts, spark.createDataFrame(pairs, "u long, w long, n0 long, n1 long"), models)
    bigrams = {(r.u, r.w): (r.p0, r.p1) for r in made.collect()}
    for u in contexts:
        for y in (0, 1):
            assert abs(sum(bigrams[key[u], key[w]][y] for w in every) - 1) < 1e-9
            assert all(abs(bigrams[key[u], key[w]][y] - q(y, u, w)) < 1e-12 for w in every)
    model = toxicity.fit_counts(docs, table)
    assert len(model.words) and len(model.bigrams)
    for _, t in rows:
        assert abs(model.ratio(toxicity.word_hashes(t, hashes)) - ratio(t)) < 1e-9


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = [(k, ("nasty words here " if k % 2 else "kind words here ") + f"n{k}") for k in range(400)]
    docs = H.documents(spark, rows + [(9001, None), (9002, ""), (None, "nasty words"), (9003, "nasty words"), (9003, "nasty words")])
    out = toxicity.score_toxicity(H.with_clashing_columns(docs), labels).collect()
    assert len(out) == 405 and all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 400)
    assert len({r.score for r in out if r.doc_id in (9001, 9002)}) == 1 and len({r.score for r in out if r.doc_id == 9003}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input against what it promises."""
    from tessera.llm import decontam, linededup, minhash, packing, quality

    docs = H.table(spark, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"test-stage{k}")
        stage(spark, tables[-1], H.SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    assert all(t.columns == columns for t in tables[:5])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = quality.judge_quality(tables[0]).where("kept")
    assert ids(tables[1]) == ids(kept) and tables[0].count() > tables[1].count() > 0
    gone = {}
    for r in linededup.line_classes(tables[1]).where("not kept").collect():
        gone.setdefault(r.doc_id, set()).add(r.line_no)
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(r.doc_id, ()))
            for r in tables[1].collect()}
    assert gone and {r.doc_id: r.text for r in tables[2].collect()} == want
    components, _ = H.near_duplicate_components({r.doc_id: r.text for r in tables[2].collect()})
    assert ids(tables[3]) == sorted(set(components.values()))
    leaked = {r.doc_id for r in decontam.matches(tables[3], H.table(spark, "benchmark")).collect()}
    assert ids(tables[4]) == sorted(set(ids(tables[3])) - leaked)
    assert sorted(tables[5].collect()) == sorted(packing.pack(tables[4]).collect())
    assert corpus_pipeline.run(spark, H.SF).count() == tables[4].count()
    assert minhash.one_of_each_group(tables[4]).count() == tables[4].count()
