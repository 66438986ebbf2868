"""Stages and operators that SQL cannot express, against plain versions and on odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabweave.llm import language_id, mixing, quality_rules, url_filter
from tabweave.llm.common import string_bytes
from tabweave.llm.quality_classifier import fit as fit_quality
from tabweave.llm.quality_classifier import score as score_quality

ODD = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (3, "x" * 200_000, "en", "s"), (None, "the cat and the dog", "en", "s"), (4, "word " * 5000, None, "s")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)


def prose(spark):
    en = "the cat and the dog of the house is in the garden that was near to the river and we are here for it".split()
    de = "der hund und die katze des hauses ist in dem garten der nahe an dem fluss war und wir sind hier für das".split()
    rows = []
    for i in range(240):
        words = (en, de)[i % 2]
        rows.append((i, " ".join(words[(i * 7 + j * j + j) % len(words)] + ("" if j % 9 else str(i)) for j in range(90)), ("en", "de")[i % 2], f"src{i % 3}", 1))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage):
    rows = stage(spark, odd(spark), "").collect()
    assert len(rows) <= len(ODD)
    assert not stage(spark, odd(spark, []), "").collect()


def test_near_copies_leave_one_document(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "en", "s"), (3, base + " more", "en", "s"), (9, base.upper(), "en", "s"), (1, " ".join(f"v{i}" for i in range(200)), "en", "s")]
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, odd(spark, rows), "").collect()) == [1, 3]


def test_languages_of_clean_prose(spark):
    df = prose(spark)
    out = language_id.identify(df, language_id.fit(df), F.col("text"), host=F.col("source")).collect()
    assert all(r.language == r.lang and r.kept for r in out)


@pytest.mark.parametrize("parts", [1, 7])
def test_every_labelled_language_is_learned(spark, parts):
    fi = ["tämä on talo ja kissa istuu siellä puutarhassa joen luona", "kissa ja koira ovat talossa ja puutarha on joen luona", "talo on siellä ja koira istuu puutarhassa"]
    df = prose(spark).drop("source", "n_chars")
    df = df.unionByName(spark.createDataFrame([(1000 + i, t, "fi") for i, t in enumerate(fi)] + [(None, "zde je dům a kočka sedí na zahradě u řeky", "cs")], "doc_id long, text string, lang string"))
    df = df.orderBy("lang").coalesce(1).repartitionByRange(parts, "lang")
    with pytest.warns(UserWarning, match="cs, fi"):
        model = language_id.fit(df, sample=20)
    assert model.languages == ["cs", "de", "en", "fi"]
    new = spark.createDataFrame([(1, "koira istuu talossa ja kissa on puutarhassa", "fi"), (2, "qzxqvv jjkqq wxzzq vvkqjx " * 9, "und")], "doc_id long, text string, lang string")
    out = language_id.identify(df.unionByName(new), model, F.col("text"), carry=["lang"]).collect()
    assert len(out) == 246 and all(r.language == r.lang for r in out)


def test_fusion_against_a_plain_version(spark):
    model = language_id.fit(prose(spark))
    en, de = "the cat and the dog of the house", "der hund und die katze des hauses"
    texts = [en, de, en + " der", None, "", "zzqq xx", de, en, en, None]
    rows = [(i, t, ["a.x.org", "b.x.org", "a.x.org", "c.y.de", None][i % 5], ["org", "org", "org", "de", None][i % 5], [None, "en", "de"][i % 3]) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, text string, host string, suffix string, declared string, language string")
    got = {r.page_id: r for r in language_id.identify(df, model, F.col("text"), F.col("host"), F.col("suffix"), F.col("declared"), carry=["page_id"]).collect()}
    names = [*model.languages, language_id.UND]
    n = len(names)
    likely = [model.likelihoods(*string_bytes(pa.array([r[1] or ""])))[0] for r in rows]
    label = [int(x.argmax()) for x in likely]
    count = lambda mine: np.bincount([label[i] for i in range(len(rows)) if mine(rows[i])], minlength=n).astype(float)
    overall = (count(lambda r: True) + 1) / (len(rows) + n)
    toward = lambda own, base: (own + language_id.STRENGTH * base) / (own.sum() + language_id.STRENGTH)

    def told(at, value):
        values = {r[at] for r in rows} - {None}
        total = sum(count(lambda r, v=v: r[at] == v) for v in values)
        return np.log((count(lambda r: r[at] == value) + 1) / (total + len(values) + 1)) if value is not None else 0

    for r, x in zip(rows, likely, strict=True):
        domain = ".".join(r[2].split(".")[-2:]) if r[2] else None
        prior = overall if r[2] is None else toward(count(lambda o: o[2] == r[2]), toward(count(lambda o: o[2] is not None and o[2].endswith(domain)), overall))
        scores = x + np.log(prior) + told(3, r[3]) + told(4, r[4])
        p = np.exp(scores - scores.max())
        p /= p.sum()
        silent = not x.any() and r[2] is None and r[4] is None
        assert got[r[0]].language == (language_id.UND if silent else names[int(scores.argmax())]) and abs(got[r[0]].posterior - p.max()) < 1e-9


def test_evidence_of_pages(spark):
    pages = [("http://A.b.Org:80/x", "<HTML lang='DE-at'><script>var x='<p>'</script><!-- c --><p>der <b>hund</b>", "a.b.org", "org", "de"), ("no address", None, None, None, None), ("x://", "", None, None, None), ("http://h", "<html><style>p{}</style>a", "h", "h", None)]
    df = spark.createDataFrame([p[:2] for p in pages], "url string, html string")
    got = df.select(language_id.url_host(F.col("url")), language_id.url_suffix(F.col("url")), language_id.page_declared(F.col("html")), language_id.page_text(F.col("html"))).collect()
    assert [tuple(r)[:3] for r in got] == [p[2:] for p in pages]
    assert [r[3].split() for r in got] == [["der", "hund"], [], [], ["a"]]


def test_stages_keep_columns_of_their_own_names(spark):
    rng = np.random.default_rng(6)
    lists = [(r.text.split(), r.lang) for r in prose(spark).limit(2).collect()]
    rows = [(i, " ".join([*rng.choice(lists[i % 2][0], 60), *(f"word{i}x{j}" for j in range(40))]), lists[i % 2][1], f"src{i % 3}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in ("kept", "language", "topic", "n_words", "weight", "_tw_text", "posterior")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        rows = out.collect()
        assert len(rows) > 100 and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in ("kept", "language", "topic", "n_words", "weight", "_tw_text", "posterior"))


def test_rules_keep_clean_prose_and_reject_repetition(spark):
    df = prose(spark).unionByName(odd(spark, [(900, "buy now " * 200, "en", "s"), (901, "the and of", "en", "s")]))
    kept = {r.doc_id for r in quality_rules.judge(df).filter("kept").collect()}
    assert not kept & {900, 901}


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100), ("a", "de", "x", 300), ("b", "en", "x", 500), ("b", "de", "x", 100)], "source string, lang string, topic string, tokens long")
    rows = mixing.rake(cells, targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.25, "de": 0.75}}, sweeps=20).collect()
    total = sum(r.weight for r in rows)
    assert abs(sum(r.weight for r in rows if r.source == "a") / total - 0.5) < 1e-6 and abs(sum(r.weight for r in rows if r.lang == "en") / total - 0.25) < 1e-6


def test_mixing_draws_by_the_calibrated_probability(spark):
    out = mixing.mix(prose(spark)).collect()
    assert len(out) == 240 and all(0 <= r.probability <= 1 for r in out)
    expected, total = sum(r.n_tokens * r.probability for r in out), sum(r.n_tokens for r in out)
    assert abs(expected / total - mixing.SHARE) < 0.01


def test_mixing_of_many_cells_is_the_same(spark, monkeypatch):
    df = prose(spark).unionByName(odd(spark)).withColumn("topic", F.lit("mine"))
    fields = ("doc_id", "n_tokens", "weight", "probability", "kept", "topic")
    rows = lambda: sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in fields) for r in mixing.mix(df, sweeps=2).collect()), key=repr)
    one = rows()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows() == one and len(one) == 246
    assert mixing.mix(df.limit(0), sweeps=1).count() == 0


def test_longest_rule_wins(spark):
    urls = ["http://a.example.org/es/x", "http://example.org/en/12", "http://EXAMPLE.org/x?y", "https://x.com/fr/", "https://x.com/de/q#z", "http://notexample.org/es/", "no scheme", None]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict, r.host, r.path) for r in url_filter.judge(df).collect()}
    assert got[0][:2] == ("example.org/es/", "block") and got[1][:2] == ("example.org/en/1", "block") and got[2] == ("org/", "allow", "example.org", "/x")
    assert got[3][:2] == ("com/fr/", "allow") and got[4][:2] == ("com/de/", "block") and got[5][0] == "org/" and got[6][0] is None and got[7][2:] == ("", "")


def test_quality_on_held_out_rows(spark):
    rows = [(i, ("good clean prose about rivers " if i % 2 else "click $$$ now %% win ") * 8 + str(i), "en", "s") for i in range(300)]
    df = odd(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in score_quality(df, fit_quality(df, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i] >= 0.5) == (i % 2 == 1) for i in held) > 0.95 * len(held)
    assert {r.score for r in score_quality(df.limit(5), fit_quality(df, labels.limit(0))).collect()} == {0.5}


def test_mixing_by_given_topics(spark):
    rows = [(i, f"word {i} " * 5, "en", "s", "sport" if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mixing.mix(df, targets={"topic": {"sport": 0.5, "": 0.5}}, share=0.4, topics=F.col("topic")).collect()
    assert {r.topic for r in out} == {"sport", ""}
    by = {t: sum(r.n_tokens * r.probability for r in out if r.topic == t) for t in ("sport", "")}
    assert abs(by["sport"] - by[""]) < 1e-6 * by[""]
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "topic", "n_tokens", "weight", "probability", "kept"}
