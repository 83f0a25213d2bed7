import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pamsieve.llm import language_id as li

SF = "/root/testdata/sf0.001"


def test_parts():
    assert li.visible("<p>a&amp;b</p><script>x</script><!-- c --> d").split() == ["a&b", "d"]
    assert li.address("https://u:p@WWW.a.co.uk:80/fr/1") == ("www.a.co.uk", "a.co.uk", "uk")
    assert li.address("no address") == li.address(None) == ("", "", "")
    assert len(li.trigrams("")) == len(li.trigrams(None or "12 34")) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_held_out_accuracy_of_the_text_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 80")
    model = li.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    right = [model.languages[int(np.argmax(model.log_likelihood(r.text)))] == r.lang for r in held]
    assert np.mean(right) > 0.97


def tiny_model():
    table = np.zeros((li.BINS, 2), np.float32)
    for word, k in (("hello", 0), ("world", 0), ("hallo", 1), ("welt", 1)):
        at = li.trigrams(word)
        table[at, k] += 1.0
        table[at, 1 - k] -= 1.0
    return li.TextModel(["en", "de"], table, 48.0)


def page(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")


def test_evidence_is_fused(spark):
    rows = [(i, "http://a.de/x", '<html lang="de">hallo welt') for i in range(30)] + [(100 + i, "http://b.com/x", '<html lang="en">hello world') for i in range(30)]
    rows += [(200, "http://a.de/y", "<html>"), (201, "http://b.com/y", "<p>"), (202, "http://c.org/", '<html lang="de"><p>..'), (203, None, None), (None, "x", "hello"), (203, None, None)]
    got = {}
    for r in li.identify_languages(page(spark, rows), tiny_model()).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    lang = lambda i: got[i][0].lang
    assert all(lang(i) == "de" for i in range(30)) and all(lang(100 + i) == "en" for i in range(30))
    assert lang(200) == "de"  # its host and suffix
    assert lang(201) == "en" and lang(202) == "de" and lang(None) == "en"
    assert got[203][0] == got[203][1]
    assert all(abs(r.p_de + r.p_en - 1) < 1e-9 and r.confidence == max(r.p_de, r.p_en) for rs in got.values() for r in rs)
    assert li.identify_languages(page(spark, []), tiny_model()).collect() == []


def test_without_labelled_rows_nothing_is_told(spark):
    model = li.train(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string").withColumn("n", F.lit(1)))
    assert model.languages == ["und"]
    got = li.identify_languages(page(spark, [(1, "http://a.de", "hallo"), (2, None, None)]), model).collect()
    assert [(r.lang, r.confidence) for r in got] == [("und", 1.0)] * 2


def test_rare_languages_and_whole_texts_are_learned(spark):
    rows = [(f"common words number {i} here", "en") for i in range(400)] + [("x " * 3000 + "seltene sprache", "de"), (None, "fr"), ("12", "la")]
    rows += [("a very common copy", "en")] * 300
    model = li.train(spark.createDataFrame(rows, "text string, lang string"), max_a_language=20)
    assert model.languages == ["de", "en", "la"]
    assert int(np.argmax(model.log_likelihood("seltene"))) == 0 and int(np.argmax(model.log_likelihood("common words"))) == 1


def test_hostile_pages_take_time_in_proportion():
    n = 1 << 20
    for part in ("<script>", "<meta ", "<!--", "<", "<html lang", '<meta http-equiv="content-language" ', "<html lang=" + " " * 1000, "&amp", "<p"):
        for page_ in (part * (n // len(part)), part * (n // len(part)) + ">"):
            began = time.perf_counter()
            li.parse(page_)
            assert time.perf_counter() - began < 10
    assert li.parse('<!-- <html lang="fr"> --><META content="de" HTTP-EQUIV=content-language><p')[0].split() == ["<p"]
    assert li.parse('<meta http-equiv="Content-Language" content="DE-at"><b>')[1] == "de"
    assert li.parse("<script>a<b</script >c<style>d")[0].split() == ["c", "d"]


def fused(rows, model, host_strength=8.0, domain_strength=16.0, smoothing=1.0):
    """p of each language for each row, straight from the definitions."""
    k = range(len(model.languages))
    seen = []
    for url, html_ in rows:
        text, declared = li.parse(html_)
        ll = [float(x) for x in model.log_likelihood(text)]
        e = [math.exp(x - max(ll)) for x in ll]
        seen.append((*li.address(url), declared, ll, [x / sum(e) for x in e]))
    whole = [sum(s[5][i] for s in seen) + smoothing for i in k]
    prior = [w / sum(whole) for w in whole]
    out = []
    for me in range(len(seen)):
        others = [s for j, s in enumerate(seen) if j != me]
        alike = [[s for s in others if s[c] == seen[me][c]] for c in range(4)]
        soft = [[sum(s[5][i] for s in same) for i in k] for same in alike]
        domain = [(soft[1][i] + domain_strength * prior[i]) / (len(alike[1]) + domain_strength) for i in k]
        host = [(soft[0][i] + host_strength * domain[i]) / (len(alike[0]) + host_strength) for i in k]
        score = [seen[me][4][i] + math.log(host[i]) + sum(math.log((soft[c][i] + smoothing * prior[i]) / (whole[i] + smoothing)) for c in (2, 3)) for i in k]
        e = [math.exp(x - max(score)) for x in score]
        out.append([x / sum(e) for x in e])
    return out


def test_fusion_against_its_definition(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        url = rng.choice([None, "", "http://a.de/", "http://x.a.de/1", "https://b.com/", "http://c.co.uk/", "http://d.co.uk"])
        lang = rng.choice(["", ' lang="de"', " lang=en", " lang='fr'"])
        rows.append((i, url, rng.choice([None, "", f"<html{lang}>" + " ".join(rng.choices(["hello", "world", "hallo", "welt", "x"], k=rng.randint(0, 6)))])))
    want = fused([r[1:] for r in rows], tiny_model())
    for r in li.identify_languages(page(spark, rows).repartition(3), tiny_model()).collect():
        p = want[r.page_id]
        assert abs(r.p_en - p[0]) < 1e-9 and abs(r.p_de - p[1]) < 1e-9
        assert r.lang == ("en" if p[0] >= p[1] else "de") or abs(p[0] - p[1]) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_accuracy_on_pages(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    got = li.identify_languages(pages, li.train(docs))
    truth = pages.select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("truth"))
    share = got.join(truth, "page_id").agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0]
    assert share > 0.97
