"""Readers and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from wordloom.sources import lines as L
from wordloom.sources import readers as R


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_puns(spark, tmp_path):
    path = put(tmp_path, "p.csv", "label,text\n1,one, two  three\r\n0,four\n")
    assert got(R.puns(spark, path).select("label", "words")) == [(0, ["four"]), (1, ["one,", "two", "three"])]


def test_raw_union(spark, tmp_path):
    a, b, c = put(tmp_path, "a", '"a pun"\n'), put(tmp_path, "b", "plain\n"), put(tmp_path, "c", "too short a one\nthis one, has more than five\n")
    assert got(R.raw_puns(spark, a, b, c)) == [("neg", "plain", -1), ("proverb", "this one, has more than five", -1), ("pun", "a pun", 1)]


def test_one_liners_of_a_code_page(spark, tmp_path):
    a, b = put(tmp_path, "a.txt", "“quoted”\r\nplain", "windows-1252"), put(tmp_path, "b.txt", "no\n", "windows-1252")
    assert got(R.one_liners(spark, a, b)) == [("no", -1), ("plain", 1), ("“quoted”", 1)]


def test_hashtag_folders(spark, tmp_path):
    put(tmp_path, "one/A.tsv", "1\t@midnight hey #A\t2\n")
    put(tmp_path, "one/B.tsv", "2\told\t0\n")
    put(tmp_path, "two/B.tsv", "3\tnew #B_x\t1\n")
    folders = [f"file://{tmp_path}/one", f"file://{tmp_path}/two"]
    assert got(R.hashtag_files(spark, folders, drop_midnight=True, hashtags="drop")) == [("A", "1", "hey", 2), ("B", "3", "new", 1)]
    assert got(R.hashtag_files(spark, folders[1:], hashtags="words")) == [("B", "3", "new B_x", 1)]
    put(tmp_path, "bad/C.tsv", "only two\tfields\n")
    with pytest.raises(Exception, match="not three fields"):
        R.hashtag_files(spark, [f"file://{tmp_path}/bad"]).collect()


def test_rated_tweets(spark, tmp_path):
    path = put(tmp_path, "h.csv", 'id,text,h,n,a,b,c,d,e,avg\n1,"two\nlines",1,3,1,1,1,0,0,2.5\n2,flat,0,0,,,,,,NULL\n')
    assert got(R.rated_tweets(spark, path)) == [("1", "two\nlines", 1, 2.5), ("2", "flat", 0, 0.0)]
    assert got(R.rated_tweets(spark, put(tmp_path, "t.csv", "id,text\n9,x\n"), train=False)) == [("9", "x", None, None)]


def test_evocation_zips_lines(spark, tmp_path):
    p, s = put(tmp_path, "p", "a,b\nc,d\n"), put(tmp_path, "s", "10 20\n0 100 50\n")
    q, t = put(tmp_path, "q", "a,b\n"), put(tmp_path, "t", "90\n")
    assert got(R.evocation(spark, [(p, s), (q, t)])) == [("a", "b", 0.4), ("c", "d", 0.5)]


def test_responses(spark, tmp_path):
    path = put(tmp_path, "s.csv", "cue,R1,R2,R3\ndog,cat,No More responses,x\ndog,cat,bone,NA\n")
    assert got(R.responses(spark, path)) == [("dog", "bone", 0.5), ("dog", "cat", 1.0)]
    assert got(R.responses(spark, path, ["R1"], as_count=True)) == [("dog", "cat", 2)]
    with pytest.raises(ValueError):
        R.responses(spark, path, ["R9"])
    with pytest.raises(ValueError):
        R.responses(spark, put(tmp_path, "t.csv", "word,R1,R2,R3\na,b,c,d\n"))


def test_strengths_and_xml(spark, tmp_path):
    assert got(R.strengths(spark, put(tmp_path, "s.tsv", "cue\tresponse\ta\tb\tstrength\ndog\tcat\t1\t2\t0.25\n"))) == [("dog", "cat", 0.25)]
    eat = put(tmp_path, "e.xml", '<eat><stimulus word="DOG" all="10"><response word="CAT" n="4"/><response word="BONE" n="1"/></stimulus></eat>')
    assert got(R.association_xml(spark, eat, "all", "n")) == [("DOG", "BONE", 0.1), ("DOG", "CAT", 0.4)]
    usf = put(tmp_path, "u.xml", '<usf><stimulus word="DOG"><response word="CAT" g="20" p="5"/></stimulus></usf>')
    assert got(R.association_xml(spark, usf, "g", "p")) == [("DOG", "CAT", 0.25)]


def test_pajek(spark, tmp_path):
    path = put(tmp_path, "g.net", '*Vertices 2\n1 "red fox"\n2 "dog"\n*Arcs\n1 2 3.5\n2 1 1\n')
    vertices, arcs = R.pajek_graph(spark, path)
    assert got(vertices) == [(1, "red fox"), (2, "dog")] and got(arcs) == [("dog", "red fox", 1.0), ("red fox", "dog", 3.5)]
    text = [r.line for r in R.pajek_text(vertices, arcs).orderBy("part", "line").collect()]
    assert text == ["*Vertices 2", '1 "dog"', '2 "red fox"', "*Arcs", "1 2 1.0", "2 1 3.5"]


def test_word_files(spark, tmp_path):
    assert got(R.word_vectors(spark, put(tmp_path, "v.txt", "2 2\ncat 1 2.5\ndog 0 1\n"))) == [("cat", [1.0, 2.5]), ("dog", [0.0, 1.0])]
    assert got(R.ngram_counts(spark, put(tmp_path, "n.tsv", "a b\t7\n"))) == [("a b", 7)]
    assert got(R.ngram_counts(spark, put(tmp_path, "r.tsv", "a b\t7\t1\t5\t2\n"), raw=True)) == [("a b", 12)]
    assert got(R.tagged_sentences(spark, put(tmp_path, "t.tsv", "a b\tN V\t0.5 1\tA b\n"))) == [(["a", "b"], ["N", "V"], [0.5, 1.0], "A b")]


def test_domains_and_merge(spark):
    rows = spark.createDataFrame([("001 dog#n#1 pets animals",)], "line string")
    assert got(L.wordnet_domains(rows)) == [("001", "dog.n.1", ["pets", "animals"])]


def test_side_cars_raise_on_a_missing_key(spark):
    tweets = spark.createDataFrame([(1,), (2,)], "id int")
    one = spark.createDataFrame([(1, 0.5)], "id int, x double")
    assert got(R.side_cars(tweets.where("id = 1"), "id", one)) == [(1, 0.5)]
    with pytest.raises(Exception, match="no features for"):
        R.side_cars(tweets, "id", one).collect()


def test_feature_store_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id int, x double, hashtag string")
    R.write_features(rows, "id", f"file://{tmp_path}/f")
    assert got(R.read_features(spark, "id", f"file://{tmp_path}/f", ["x"])) == [(1, 2.0), (2, 3.0)]
    R.write_predictions(rows, f"file://{tmp_path}/p")
    assert sorted(p.name for p in (tmp_path / "p").glob("hashtag=*")) == ["hashtag=a", "hashtag=b"]
    with pytest.raises(ValueError):
        R.with_derived(rows, x=F.lit(1))


def test_models_come_back(spark, tmp_path):
    from wordloom.operators import models as M

    rows = spark.createDataFrame([(float(i), float(i % 2), float(i % 2)) for i in range(20)], "a double, b double, y double")
    model = M.pipeline("mlp", ["a", "b"], "y").fit(rows)
    R.save_model(model, f"file://{tmp_path}/m")
    assert got(R.load_model(f"file://{tmp_path}/m").transform(rows).select("prediction")) == got(model.transform(rows).select("prediction"))
