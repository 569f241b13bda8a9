"""Similarity, dereplication, origins, gene profiles, sources and sinks."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quadrat.operators import dereplicate, genes, graph, origins, similarity, sketches
from quadrat.plans import analyses
from quadrat.sources import delimited, fasta, workbook


def words(text, k):
    w = text.split()
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def ident(a, b, k):
    j = len(a & b) / len(a | b)
    return max(0.0, 1 + math.log(2 * j / (1 + j)) / k) if j else 0.0


def greedy(texts, quality, k, threshold):
    sets = {i: words(t, k) for i, t in texts.items()}
    reps = []
    for i in sorted(texts, key=lambda i: (-quality[i], i)):
        if not any(ident(sets[i], sets[r], k) >= threshold - 1e-12 for r in reps):
            reps.append(i)
    out = {}
    for i in texts:
        out[i] = i if i in reps else max(reps, key=lambda r: (ident(sets[i], sets[r], k), quality[r], -r))
    return out


def corpus(seed, shared):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for base in range(12):
        body = ([f"boiler{i}" for i in range(20)] if shared else []) + [rng.choice(vocabulary) for _ in range(30)]
        for copy in range(rng.randint(1, 5)):
            edited = list(body)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(edited)
    exact = texts[0]
    for _ in range(20):  # a third of the items are copies of one
        texts[len(texts)] = exact
    texts[len(texts)], texts[len(texts) + 1], texts[len(texts) + 2] = "short one", "short one", ""
    return texts


@pytest.mark.parametrize("seed,shared,precluster,sketch", [(1, False, 80.0, 256), (2, True, 80.0, 512), (2, True, None, 512)])
def test_dereplication_equals_the_sequential_greedy(spark, seed, shared, precluster, sketch):
    texts = corpus(seed, shared)
    quality = {i: (i * 37) % 50 for i in texts}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    tokens = similarity.item_tokens(df, "id", "text", 3)
    ranks = spark.createDataFrame(list(quality.items()), "id int, quality int")
    got = dereplicate.dereplicate(tokens, ranks, 3, 90.0, precluster, sketch).collect()
    assert {r.member: r.representative for r in got} == greedy(texts, quality, 3, 0.9)


def test_later_rounds_read_the_undecided_only(spark, monkeypatch):
    chain = [" ".join(f"w{j}" for j in range(i, i + 40)) for i in range(12)]  # each is like the next few only
    far = [" ".join(f"x{i}y{j}" for j in range(40)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(chain + far)), "id int, text string")
    quality, read, verify = df.select("id", F.lit(1).alias("quality")), [], dereplicate.verify
    monkeypatch.setattr(dereplicate, "verify", lambda pairs, tokens, *more: read.append(tokens.count()) or verify(pairs, tokens, *more))
    got = dereplicate.dereplicate(similarity.item_tokens(df, "id", "text", 3), quality, 3, 90.0, None).collect()
    assert {r.member: r.representative for r in got} == greedy(dict(enumerate(chain + far)), dict.fromkeys(range(42), 1), 3, 0.9)
    assert len(read) > 2 and read[-2] < read[0] == read[-1] < 38 * 42  # the last one assigns items to representatives


@pytest.mark.parametrize("most", [7, 500])
def test_preclusters_that_fit_are_decided_in_a_task(spark, monkeypatch, most):
    texts = corpus(4, False)
    chain = [" ".join(f"w{j}" for j in range(i, i + 40)) for i in range(8)]
    texts = {**texts, **dict(enumerate(chain, 1_000))}
    quality, rounds, verify = {i: (i * 37) % 50 for i in texts}, [], dereplicate.verify
    monkeypatch.setattr(dereplicate, "PART_ITEMS", most)
    monkeypatch.setattr(dereplicate, "verify", lambda pairs, *more: rounds.append(pairs.count()) or verify(pairs, *more))
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    ranks = spark.createDataFrame(list(quality.items()), "id int, quality int")
    got = dereplicate.dereplicate(similarity.item_sets(df, "id", "text", 3), ranks, 3, 90.0, 80.0).collect()
    assert {r.member: r.representative for r in got} == greedy(texts, quality, 3, 0.9)
    sets = {i: words(t, 3) for i, t in texts.items()}
    assert all(r.similarity == pytest.approx(ident(sets[r.member], sets[r.representative], 3)) for r in got)
    assert (sum(rounds) == 0) == (most == 500)  # all in one job, or rounds for the chain


def test_packed_sets(spark):
    """The same sets as in rows, without an exchange of tokens; ids that come twice have one set."""
    texts = [(i, t) for i, t in corpus(5, True).items()] + [(3, "more words of an item that comes twice"), (4, None), (None, "no id")]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = similarity.item_tokens(df, "id", "text", 3).where("id IS NOT NULL").distinct()
    want = sorted(map(tuple, rows.collect()))
    for packed in (similarity.item_sets(df, "id", "text", 3), sketches.packed(rows)):
        assert packed.count() == packed.select("id").distinct().count() == len(texts) - 3
        assert sorted(map(tuple, sketches.unpacked(packed).collect())) == want
    one = similarity.item_sets(df.where("id > 4"), "id", "text", 3)
    for table in (one, sketches.summaries(one, 3, 64)):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    equal = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c e")], "id int, text string")
    found = {r.id: (r.sig, tuple(r["keys"])) for r in sketches.summaries(similarity.item_sets(equal, "id", "text", 3), 3, 64).collect()}
    assert found[1] == found[2] and found[1][0] != found[3][0] and len(found[1][1]) == 21
    kept = {r.id for r in sketches.may_hold(one, spark.createDataFrame([(7,), (9,), (9_999,)], "id int")).collect()}
    assert {7, 9} <= kept and len(kept) < one.count()


def test_similarity_of_packed_sets(spark, monkeypatch):
    monkeypatch.setattr(sketches, "PAIRS", 40)  # groups are dealt to several tasks
    texts = corpus(6, False)
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    reps = spark.createDataFrame([(i,) for i in [*texts, 5_000] if i % 4 == 0], "id int")
    parts = {i: words(t, 3) for i, t in texts.items()}
    want = {(r, i): ident(parts[r], parts[i], 3) for r in texts if r % 4 == 0 for i in texts if i != r}
    want = {k: pytest.approx(v) for k, v in want.items() if v >= 0.85}
    for sketch in (None, 512):
        got = similarity.similarity_to(reps, similarity.item_sets(df, "id", "text", 3), 3, 0.85, sketch).collect()
        assert {(r.rep, r.id): r.similarity for r in got} == want and len(got) == len(want)


def test_similarity_to_representatives(spark):
    texts = corpus(3, True)
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    tokens = similarity.item_tokens(df, "id", "text", 3)
    got = {(r.rep, r.id): r.similarity for r in similarity.similarity_to(tokens.filter("id % 4 = 0"), tokens, 3, 0.85).collect()}
    parts = {i: words(t, 3) for i, t in texts.items()}
    want = {(r, i): ident(parts[r], parts[i], 3) for r in texts if r % 4 == 0 for i in texts if i != r}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.85}


def test_band_join_finds_nearly_all_pairs(spark):
    """Recall against the exact join at several sizes of the sketch, on long sets with a token that all share."""
    rng = random.Random(8)
    rows, sets = [], {}
    for family in range(30):
        base = [rng.getrandbits(50) for _ in range(rng.randint(60, 900))]
        for member in range(4):
            own = {t if rng.random() > 0.05 * member else rng.getrandbits(50) for t in base} | {1}
            sets[4 * family + member] = own
            rows += [(4 * family + member, t) for t in own]
    tokens = spark.createDataFrame(rows, "id int, token long")
    index = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    k, limit = 21, similarity.min_jaccard(0.97, 21)
    wanted = {(a, b) for a in sets for b in sets if a != b and index(a, b) >= limit}
    for size, least in ((128, 0.95), (512, 0.99)):
        found = {(r.rep, r.id) for r in similarity.similarity_to(tokens, tokens, k, 0.97, size).collect()}
        assert found <= wanted and len(found) >= least * len(wanted) > 100


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(9)
    rows = [(i, rng.getrandbits(40)) for i in (1, 2) for _ in range(3_000)]
    rows += [(2, t) for i, t in rows if i == 1][:2_000]
    whole = spark.createDataFrame(rows, "id int, token long")
    halves = [whole.filter(f"token % 2 = {i}") for i in (0, 1)]
    for make in (lambda t: sketches.bottom_rows(t, 400), lambda t: sketches.bin_minima(t, 128).select("id", "token")):
        merged = make(make(halves[0]).union(make(halves[1])))
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, make(whole).collect()))
    a, b = ({t for i, t in rows if i == k} for k in (1, 2))
    pair = sketches.bottom_sketch(sketches.bottom_rows(whole, 400)).agg(
        F.max_by("sketch", -F.col("id")).alias("a"), F.max_by("sketch", "id").alias("b"))
    got = pair.select(sketches.estimated_jaccard(F.col("a"), F.col("b"), 400)).head()[0]
    assert abs(got - len(a & b) / len(a | b)) < 0.08


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 150), (150, 201)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150, 201: 150}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dna_kmers_are_strand_neutral(spark):
    seq = "ACGTTGCAAGTCCATGCA"
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([("a", "c1", seq), ("b", "c1", back), ("c", "c1", seq[:9]), ("c", "c2", seq[9:])],
                               "genome string, contig string, seq string")
    got = {}
    for r in similarity.genome_tokens(df, 5).collect():
        got.setdefault(r.id, set()).add(r.token)
    assert got["a"] == got["b"] and len(got["c"]) < len(got["a"])


def test_origins(spark):
    rows = [("A", "own1", "own1"), ("A", "own1", "x1"), ("A", "own2", "own2"), ("B", "own1", "own1"), ("B", "b9", "own2"), ("B", "b9", "b9")]
    clusters = spark.createDataFrame(rows, "database string, representative string, member string")
    present = origins.shared_or_unique(clusters, F.col("representative").startswith("own"), [("^x", "A"), ("^b", "B")])
    assert {(r.database, r.representative): r.present for r in present.collect()} == {("A", "own1"): 1, ("A", "own2"): 0, ("B", "own1"): 0}
    sizes = spark.createDataFrame([("A", 8), ("B", 3)], "database string, size int")
    got = {(r.database, r.presence): (r["count"], r.total, r.percent) for r in origins.origin_counts(present, sizes).collect()}
    assert got == {("A", "improved"): (1, 2, 25.0), ("A", "unique"): (1, 2, 25.0), ("B", "unique"): (1, 1, 33.33)}
    name = origins.by_pattern(F.col("member"), [("x", "first"), ("1", "second")])
    assert [r[0] for r in clusters.limit(3).select(name).collect()] == ["second", "first", None]


def test_gene_profile(spark):
    g = spark.createDataFrame([("GH1", "m", "Xylan Backbone, Pectin", "f1", 2), ("GH2", "m", "Xylan", "f1", 3),
                               ("AA1", "m", "Xylan", "f1", 9), ("GH3", "m", None, "f1", 1), ("GH4", "m", "Zero", "f2", 0)],
                              "gene_id string, module string, subheader string, feature string, gene_freq int")
    taxa = spark.createDataFrame([("f1",), ("f2",)], "feature string")
    out = genes.functional_profile(g, taxa, F.col("gene_id").startswith("GH"), ["feature"], strip=[" oligo| backbone"])
    assert {(r.feature, r.subheader): r.total for r in out.collect()} == {("f1", "Xylan"): 5, ("f1", "Pectin"): 2}
    wide = genes.pivot_profile(out, ["feature"], "subheader").head()
    assert (wide.Xylan, wide.Pectin) == (5, 2)


def test_preamble_in_every_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("note\nother note\nname,x\n" + "".join(f"r{i}_{k},{k}\n" for k in range(4)))
    got = delimited.read_after_preamble(spark, str(tmp_path), 2, "name string, x int")
    assert sorted((r.name, r.x) for r in got.collect()) == [(f"r{i}_{k}", k) for i in range(3) for k in range(4)]
    assert delimited.read_after_preamble(spark, str(tmp_path), 2).columns == ["name", "x"]


def test_matrix_and_cluster_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Sample,a.bin1,b.bin2\ns1,0,2.5\ns2,1,0\n")
    got = delimited.read_abundance_matrix(spark, str(tmp_path / "m.csv"))
    assert sorted(tuple(r) for r in got.collect()) == [("s1", "b.bin2", 2.5), ("s2", "a.bin1", 1.0)]
    for db in ("dbA", "dbB"):
        (tmp_path / f"{db}_representative_genomes.tsv").write_text(f"./{db}/x.fa.1.fa\t./{db}/y.fa\n")
    paths = [str(tmp_path / f"{db}_representative_genomes.tsv") for db in ("dbA", "dbB")]
    rows = delimited.read_clusters(spark, paths).orderBy("database").collect()
    assert [tuple(r) for r in rows] == [("x.fa.1", "y", "dbA"), ("x.fa.1", "y", "dbB")]


def test_fasta(spark, tmp_path):
    (tmp_path / "g1.fa").write_text(">c1 some text\nacgt\nAC\n>c2\nTT\n")
    (tmp_path / "g2.fa").write_text(">only\nGGG")
    (tmp_path / "skip.txt").write_text(">no\nAAA\n")
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("g1", "c1", "ACGTAC"), ("g1", "c2", "TT"), ("g2", "only", "GGG")]


def test_many_genomes_take_few_files(spark, tmp_path):
    rows = [(f"g{i} 100%+=#", "c1", "ACGT" * 40) for i in range(300)] + [("g0 100%+=#", "c2 x", "TTT"), ("e", "c", "")]
    seqs = spark.createDataFrame([*rows, (None, "c", "GG"), ("n", "c", None)], "genome string, contig string, seq string").coalesce(4)
    want = sorted([*((g, c.split()[0], s) for g, c, s in rows), ("__HIVE_DEFAULT_PARTITION__", "c", "GG"), ("n", "", "")])
    fasta.write_fasta(seqs, str(tmp_path / "many"))
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "many"), "txt").collect())) == want
    assert len(list((tmp_path / "many").rglob("*.txt"))) <= 4
    fasta.write_fasta(seqs.filter("genome like 'g1%'"), str(tmp_path / "folders"), folders=True)
    got = fasta.read_fasta(spark, str(tmp_path / "folders"), "txt").collect()
    assert sorted(map(tuple, got)) == [r for r in want if r[0].startswith("g1")]


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="First" sheetId="1" r:id="a"/><sheet name="Second" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>gene_id</t></si><si><r><t>bin</t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>GH1</t></is></c><c r="B2"><v>3</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>GH2</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>1</v></c><c t="s"><v>0</v></c></row><row><c><v>7</v></c><c t="str"><v>GH9</v></c></row></sheetData></worksheet>')
    got = workbook.read_sheets_long(spark, str(tmp_path), ["gene_id"]).select("sheet_name", "gene_id", "column", "value")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "GH1", "bin1", "3"), ("2", "GH9", "bin1", "7")]


def test_sinks(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "c", "AC"), ("b", "c", "GT"), ("a", "d", "TT")], "genome string, contig string, seq string")
    reps = spark.createDataFrame([("a", "a"), ("a", "b")], "representative string, member string")
    delimited.write_clusters(reps, str(tmp_path / "c"))
    back = spark.read.schema("representative string, member string").option("sep", "\t").csv(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == [("a", "a"), ("a", "b")]
    chosen = reps.select(F.col("representative").alias("genome"))
    delimited.write_representatives(seqs, chosen, str(tmp_path / "r"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["AC", "TT"]
    delimited.write_representatives(seqs, chosen, str(tmp_path / "s"), shelves=2)
    assert sorted((r.genome, r.seq) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", "AC"), ("a", "TT")]


def test_genome_files_to_clusters_and_back(spark, tmp_path):
    rng = random.Random(6)
    base = {f"g{i}#x y+{i}": "".join(rng.choice("ACGT") for _ in range(3_000)) for i in range(5)}
    rows, near = [], {}
    for n, (name, seq) in enumerate(base.items()):
        rows += [(name, "c1", seq[:1_600]), (name, "c2", seq[1_600:])]
        other = "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in seq)
        near[f"n{n}"] = name
        rows.append((f"n{n}", "only", other))
    seqs = spark.createDataFrame(rows, "genome string, contig string, seq string")
    fasta.write_fasta(seqs, str(tmp_path / "all"))
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "all"), "txt").collect())) == sorted(rows)
    quality = spark.createDataFrame([(g, 90.0 if g in base else 50.0) for g in {r[0] for r in rows}], "id string, quality double")
    table, folder = analyses.dereplicate_genomes(spark, str(tmp_path / "all"), quality, str(tmp_path / "out"), extension="txt")
    got = spark.read.schema("representative string, member string").option("sep", "\t").csv(table)
    assert {r.member: r.representative for r in got.collect()} == {**{g: g for g in base}, **near}
    kept = {(r.genome, r.contig): r.seq for r in fasta.read_fasta(spark, folder, "txt").collect()}
    assert kept == {(g, c): s for g, c, s in rows if g in base}
