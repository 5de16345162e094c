"""Hand rows that pin down each semantic trap."""

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.operators import annotate, compliance, dedup, filters, graph, harvest, stats
from shelfmark.plans import registry, sinks
from shelfmark.sources import tables as S


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_normalize_list(spark):
    assert one(spark, C.normalize_list, "Alz(PD,AD)") == "AD;Alz;PD"
    assert one(spark, lambda c: C.normalize_list(c, ";", ";,"), "Alz(PD,AD)") == "AD);Alz(PD"
    assert one(spark, C.normalize_list, "ad; AD; PD") == "PD;ad"
    assert one(spark, C.normalize_list, "Alzheimer’s Disease; Alzheimer's Disease") == "Alzheimer's Disease"
    assert one(spark, C.normalize_list, None) == ""


def test_nfkc_comes_before_apostrophes(spark):
    assert one(spark, lambda c: C.plain_apostrophes(C.nfkc(c)), "a´") == "a ́"


def test_names_scores_numbers(spark):
    assert one(spark, C.rotate_names, "Mike A Nalls; Mike B Nalls; X") == "Nalls Mike A; Nalls Mike B; X"
    assert [one(spark, C.score_text, x) for x in ("7", " 10 ", "11", "high", "")] == ["7", "10", "N/A", "N/A", "N/A"]
    assert one(spark, C.first_number, "2,636 participants") == 2636.0
    assert one(spark, C.first_number, ",") is None
    assert one(spark, C.grade, "limited FAIR compliance") == 1.0
    assert one(spark, C.clean_vocabulary, "['Clinical', 'omics', 'Genomics', 'genetic']") == "clinical, genetics"


def test_filters(spark):
    df = spark.createDataFrame([("Vascular Dementia",), ("dementia",), (None,)], "d string")
    assert df.transform(filters.filter_by({"d": ["Dementia"], "absent": ["x"]})).count() == 1
    assert df.transform(filters.filter_by({"d": "DEMENTIA"})).count() == 2
    assert df.filter(filters.relevant(F.lit("UNKNOWN - no content"), ["NO"])).count() == 3


def test_scores(spark):
    log = spark.createDataFrame([(1, "R", "S1", "No README", "d"), (2, "R", "S2", "No README", "d")], "n long, Repository string, Study string, issue string, details string")
    assert compliance.score_app(log, "Repository", "issue", "details", "n").first().score == 8
    assert compliance.score_report(log, "Repository", "issue").first().score == 9
    repos = spark.createDataFrame([("Q",)], "Repository string")
    app = compliance.score_app(log, "Repository", "issue", "details", "n")
    assert compliance.with_compliance(repos, app, "Repository").first().score == 10
    assert compliance.with_compliance(repos, app.limit(0), "Repository", log_is_empty=True).first().score == 0
    assert compliance.with_compliance(repos, app.limit(0), "Repository").first().score == 0


def test_graph(spark):
    rows = spark.createDataFrame([(1, "a", "x;y;z", "R, Python"), (2, "b", "x;y;z", "R, MATLAB"), (3, "b", "x", "C")], "n long, name string, d string, Languages string")
    node = graph.nodes(rows, "name", "n")
    assert {(r.node_id, r.node_idx, r.d) for r in node.collect()} == {("a", 1, "x;y;z"), ("b", 2, "x")}
    edge = graph.edges(node, ["d", "absent"], ";", 1)
    assert [(r.src, r.dst, r.weight) for r in edge.collect()] == [("a", "b", 1)]
    assert graph.edges(node, ["Languages"], ",", 1).count() == 0


def test_path_graph_centrality_and_components(spark):
    node = spark.createDataFrame([(x, i) for i, x in enumerate("abcdz")], "node_id string, node_idx long")
    edge = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight int")
    assert {r.node_id: r.component for r in graph.components(node, edge).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    got = {r.node_id: round(r.centrality, 6) for r in graph.betweenness(node, edge).collect()}
    assert got == {"a": 0, "b": round(4 / 12, 6), "c": round(4 / 12, 6), "d": 0, "z": 0}
    assert sum(r.degree for r in graph.degrees(node, edge).collect()) == 2 * edge.count()


def test_sections(spark):
    text = "x\nBIOMEDICAL RELEVANCE: YES: a\n more\n\nnote Data Types: MRI\nTooling: R\nTooling: Python"
    df = spark.createDataFrame([(1, text), (2, None)], "k long, t string")
    got = {r.k: r for r in annotate.parse_sections(df, "k", "t").collect()}
    assert (got[1].biomedical_relevance, got[1].summary, got[1].data_types, got[1].tools) == ("YES: a more", "", "MRI", "Python")
    assert got[2].tools == ""


def test_searches(spark):
    day = F.lit("2026-01-01").cast("date")
    v3 = one(spark, lambda a, b, c, d: harvest.search_v3(a, b, c, d, day), "Big Study (BS)", "map", "Mild Cognitive Impairment", "x")
    assert v3.count('"mild cognitive impairment"[All Fields]') == 2 and '"Big Study"[tiab]' in v3 and '"map"' not in v3
    assert one(spark, lambda a, b: harvest.search_v2(a, b, day), "", "") == "(2023/01/02:2026/01/01[Date - Publication])"


def test_articles_and_results(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>Tau <i>in</i> brain</ArticleTitle></Article></MedlineCitation></PubmedArticle></Set>")
    assert [(r.PMID, r.Title, r.Authors) for r in S.articles(spark, str(tmp_path / "a.xml")).collect()] == [("7", "Tau", "")]
    (tmp_path / "r.jsonl").write_text('{"custom_id":"a","result":{"type":"succeeded","message":{"content":[{"text":"t"}]}}}\n{"custom_id":"b","result":{"type":"errored","error":{"message":"m"}}}\n')
    assert {r.custom_id: r.response for r in S.batch_results(spark, str(tmp_path / "r.jsonl")).collect()} == {"a": "t", "b": "ERROR - errored: m"}


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "t-1.tsv").write_text(" a \tb\n1\tN/A\n2\tx\n")
    (tmp_path / "t-2.tsv").write_text("a\tb\n3\ty\n")
    import os

    os.utime(tmp_path / "t-2.tsv", (1, 1))
    os.utime(tmp_path / "t-1.tsv", (1, 1))
    path = S.latest_file(spark, str(tmp_path), "t-*.tsv")
    assert path.endswith("t-2.tsv")
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "t-1.tsv")).collect()] == [("1", ""), ("2", "x")]
    (tmp_path / "h.log").write_text("[1/2] Searching GitHub for repositories related to A B (AB)...\n  Skipping https://github.com/g/1 - insufficient content\n[2/2] Searching GitHub for repositories related to C (CC)...\n  Skipping https://github.com/g/1 - insufficient content\n")
    assert [tuple(r) for r in S.mine_logs(spark, str(tmp_path / "h.log")).collect()] == [("https://github.com/g/1", "C", "CC")]


def test_keep_and_stats(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 9.0), (3, "b", 100.0), (4, None, None)], "n long, k string, x double")
    assert {r.n for r in dedup.keep_first(df, ["k"], [F.col("n")]).collect()} == {1, 3, 4}
    assert [r.n for r in stats.histogram(df, F.col("x"), [0.0, 25.0, 50.0, 75.0, 100.0]).orderBy("bin").collect()] == [2, 0, 0, 1]
    assert [(r.value, r.n) for r in stats.top_k(df, F.col("k"), 1).collect()] == [("a", 2)]
    assert {r["column"]: r.nulls for r in sinks.profile(df).collect()} == {"n": 0, "k": 1, "x": 1}
    empty = df.limit(0)
    assert stats.numeric_summary(empty, F.col("x")).first().n == 0 and stats.top_k(empty, F.col("k"), 3).count() == 0


def test_corpus_match_finds_phrases_of_one_or_two_words(spark):
    texts = {1: "The ADNI cohort", 2: "preadnix, UK Biobank2 and more", 3: "a -- b", 4: "uk  biobank", 5: None, 6: "the long read of ADNI data"}
    phrases = {1: "adni", 2: "UK Biobank", 3: "--", 4: "long read of", 5: None, 6: "of adni d"}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    items = spark.createDataFrame(list(phrases.items()), "ident long, phrase string")
    got = sorted(map(tuple, harvest.corpus_match(docs, "doc", "text", items, "ident", "phrase").collect()))
    assert got == sorted((d, i) for d, t in texts.items() for i, p in phrases.items() if t and p and p.lower() in t.lower())


def test_skipped_lines_that_do_not_count(spark):
    lines = ["Searching GitHub for repositories related to A ()...", "Skipping https://github.com/a/early - insufficient content", "Searching GitHub for repositories related to A B (AB)...", "Skipping https://example.org/a/b - insufficient content", "Skipping https://github.com/a/c - no licence", "Skipping https://github.com/a/d - insufficient content"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    assert [tuple(r) for r in S.skipped_urls(rows).collect()] == [("https://github.com/a/d", "A B", "AB")]


def test_lists_are_composed_before_they_are_compared(spark):
    fold = lambda x, **o: one(spark, lambda c: C.normalize_list(c, **o), x)
    assert fold("\ufb01brosis; fibrosis") == "fibrosis"
    assert fold("a\u00b4; b\u2019") == "a \u0301;b'"
    assert fold("\uff21\uff24\uff1bPD; AD") == "AD;AD;PD"  # a wide delimiter is no delimiter, though it becomes one
    assert fold("x (\uff21, b), y", split_on=",;") == one(spark, lambda c: C.normalize_list(c, split_on=",;"), "x (A, b), y")
    assert fold("") == "" and fold(None) == ""


def test_tables_are_read_by_name(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("b\ta\n1\t2\n")
    (tmp_path / "two.tsv").write_text("a\tc\tb\n3\t4\t\n")
    paths = [str(tmp_path / "one.tsv"), str(tmp_path / "two.tsv")]
    for multi_line in (True, False):
        got = S.read_table(spark, paths, ["a", "b", "d"], multi_line=multi_line)
        assert got.columns == ["a", "b", "d"] and sorted(map(tuple, got.collect())) == [("2", "1", ""), ("3", "", "")]


def test_publication_lists(spark):
    row = spark.createDataFrame([("AD, PD; ad", "Inst B; Inst A", "z; a")], '`Diseases Included` string, Affiliations string, Keywords string')
    got = S.load_publications(row).first()
    assert (got["Diseases Included"], got["Affiliations"], got["Keywords"]) == ("AD;PD", "Inst B; Inst A", "a;z")


def test_compliance_logs_and_batches_keep_the_first(spark):
    logs = spark.createDataFrame([("r", "No README", 1, 2), ("r", "No README", 0, 9), ("r", "x", 1, 1), (None, "x", 0, 0)], "Repository string, `Issue Type` string, file int, n int")
    assert sorted((r.Repository or "", r["Issue Type"], r.file, r.n) for r in S.union_compliance_logs(logs, ["file", "n"]).collect()) == [("", "x", 0, 0), ("r", "No README", 0, 9), ("r", "x", 1, 1)]
    kept, counts = S.merge_batches(spark.createDataFrame([("u", "late", 1), ("u", "first", 0), ("v", "w", 1)], "`Repository Link` string, x string, batch int"))
    assert sorted(map(tuple, kept.collect())) == [("u", "first"), ("v", "w")] and tuple(counts.first()) == (3, 2, 1)


def test_absent_batches_are_passed_over(spark, tmp_path):
    for name, rows in (("one", "u\tfirst\nv\tw\n"), ("three", "u\tlate\nx\ty\n")):
        (tmp_path / f"{name}.tsv").write_text("Repository Link\tname\n" + rows)
    paths = [str(tmp_path / f"{n}.tsv") for n in ("one", "two", "three")]
    kept, counts = S.load_repo_batches(spark, paths)
    assert sorted(map(tuple, kept.collect())) == [("u", "first"), ("v", "w"), ("x", "y")]
    assert counts.first()[:2] == (4, 3)
    assert list(S.read_present(spark, paths)) == [0, 2]
    with pytest.raises(FileNotFoundError):
        S.load_repo_batches(spark, paths[1:2])


def test_text_reports(spark):
    rows = spark.createDataFrame([(0, "levels", "Good", None, 3, 75.0), (0, "levels", "Bad", None, 1, 25.0), (1, "sizes", "mean", 2.5, 0, None)], "section_no int, section string, metric string, value double, count long, pct double")
    lines = [r.value for r in sinks.text_report(rows, "T").orderBy("section_no", "row").collect()]
    assert lines[0] == sinks.banner("T") and lines[1:4] == ["LEVELS\n" + "-" * 80, "  Good: 3 (75.0%)", "  Bad: 1 (25.0%)"] and lines[-1] == "  mean: 2.50"


def test_corpus_search_needs_every_group_and_the_day(spark):
    docs = spark.createDataFrame([(1, "ADNI and dementia", "2024-05-01"), (2, "adni alone", "2024-05-01"), (3, "adni dementia", "2019-05-01"), (4, "ad-ni dementia", "2024-05-01")], "doc long, text string, d string").withColumn("day", F.to_date("d"))
    studies = spark.createDataFrame([(7, "Alz. Initiative (ADNI)", "ADNI", "Dementia", "")], "id long, name string, short string, diseases string, modalities string")
    found = {}
    for version in (1, 2, 3):
        groups = harvest.search_groups(version, F.col("name"), F.col("short"), F.col("diseases"), F.col("modalities"))
        found[version] = sorted(r.doc for r in harvest.corpus_search(docs, "doc", "text", "day", studies, "id", groups, F.lit("2025-01-01").cast("date")).collect())
    assert found == {1: [1], 2: [1, 2], 3: [1]}


def odd_documents(spark, tmp_path):
    """A folder with texts that begin or end in the letter v and in all kinds of white space, some fields without anything."""
    blanks = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, 0x2007, 0x2029, 0x3000)))
    texts = ["vequez au " * 30, "v", f"{blanks}vin{blanks}de v{blanks}", f"{blanks}{'é' * 200}{blanks}", "é" * 201, blanks, "", None]
    rows = [(i, t, ["en", None, " "][i % 3], ["s", "", None, "v"][i % 4]) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def both_ways(spark, folder, name):
    """The rows of a query and those of its SQL, over a folder's documents."""
    got = registry.QUERIES[name](spark, folder)
    sql = registry.ORACLES[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, con.sql(sql).fetchall()))


def test_truncated_texts_equal_sql_on_odd_ends(spark, tmp_path):
    got, wanted = both_ways(spark, odd_documents(spark, tmp_path), "truncate")
    assert got == wanted


def test_record_digests_equal_sql_on_odd_ends(spark, tmp_path):
    got, wanted = both_ways(spark, odd_documents(spark, tmp_path), "record_digests")
    assert got == wanted


def test_corpus_search_of_repeated_docs_and_searches(spark, monkeypatch):
    rows = [(1, "alpha"), (1, "Beta"), (2, "alpha beta"), (3, "beta gamma"), (None, "alpha"), (None, "gamma beta"), (4, "gamma"), (5, None), (6, "alpha only")]
    docs = spark.createDataFrame(rows, "doc long, text string").withColumn("day", F.lit("2025-01-01").cast("date"))
    studies = spark.createDataFrame([(i, ["Alpha", "gamma"][: 1 + i // 8], ["beta"]) for i in range(10)] + [(90, ["alpha"], []), (91, ["nowhere"], ["beta"]), (92, [], []), (None, ["alpha"], [])], "id long, names array<string>, others array<string>")
    wanted = sorted([(d, i) for d in (1, 2, None) for i in range(10)] + [(3, 8), (3, 9)] + [(d, 90) for d in (1, 2, 6, None)], key=str)
    arrays = {"names": F.col("names"), "others": F.col("others")}
    sizes = []
    real = harvest.written
    monkeypatch.setattr(harvest, "written", lambda df: sizes.append((out := real(df)).count()) or out)
    for most in (1 << 20, 3):  # studies sent at once, and in several turns
        got = harvest.corpus_search(docs, "doc", "text", "day", studies, "id", arrays, F.lit("2025-01-01").cast("date"), most_asked=most)
        assert sorted(map(tuple, got.collect()), key=str) == wanted
    assert max(sizes) <= 25  # what is written between the steps is no product of texts and studies (before: nothing was written, and a row was made for each text and group that it meets)
    texts = docs.select("doc", "text")
    phrases = spark.createDataFrame([(i, p) for i, p in enumerate(["alpha", "beta", "gamma"])], "number long, phrase string")
    for most in (1000, 20):  # one automaton, or several
        assert sorted((str(r.doc), n) for r in harvest.found_phrases(texts, phrases, most).collect() for n in r.numbers) == sorted((str(d), n) for d, t in rows for n, p in enumerate(["alpha", "beta", "gamma"]) if t and p in t.lower())


def test_searches_look_at_a_study_by_its_first_clause_and_at_equal_ones_once():
    held = harvest.Searches([[[1], [2, 3]]] * 1000 + [[[4, 5], [2]], [[6]]])
    assert len(held.rows) == 3 and sum(map(len, held.by_number.values())) == 4
    assert [x.tolist() for x in held.met([1, 3])] == [list(range(1000))]
    assert held.met([2, 3]) == [] and [x.tolist() for x in held.met([5, 2, 6])] == [[1000], [1001]]
