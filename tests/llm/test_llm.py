import base64
import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ultradia.llm import clusters, packing, queries, residue, tokens
from ultradia.operators.linking import cells_of, components, near_cells, points_of, relabelled
from ultradia.session import written

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, words string")


# 7 -----------------------------------------------------------------------------------------------

def brute_groups(rows, radius, least):
    parent = list(range(len(rows)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, *p) in enumerate(rows):
        for j in range(i):
            if sum((a - b) ** 2 for a, b in zip(p, rows[j][1:])) <= radius * radius:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r[0])
    return {(k, min(g)) for g in groups.values() if len(g) >= least for k in g}


FZ = "feature_id long, a double, b double, c double, cluster_id string, p0 string"


def found_groups(spark, rows, radius=0.2, least=5):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FZ)
    return clusters.similar_groups(df, "feature_id", ("a", "b", "c"), radius, least)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        center = rng.choice([(0, 0, 0), (1, 1, 1), (1.25, 1, 1)])
        spread = rng.choice([0.05, 0.15, 0.8])
        rows.append((i * 3 + 1, *[c + rng.gauss(0, spread) for c in center]))
    rows += [(5000 + i, *rows[0][1:]) for i in range(20)]  # repeats
    rows += [(7000 + i, 9.0 + 0.2 * i, 9.0, 9.0) for i in range(6)]  # a chain of pairs at the radius
    got = found_groups(spark, rows).collect()
    assert {(r.feature_id, r.cluster_id) for r in got} == brute_groups(rows, 0.2, 5)
    assert len({(r.community, r.cluster_id) for r in got}) == len({r.community for r in got})


def test_dense_neighbours_that_the_graph_does_not_join(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(0, 0.04), rng.uniform(0, 0.04), 0.0) for i in range(150)] + [(1000 + i, 0.2 + rng.uniform(0, 0.04), rng.uniform(0, 0.04), 0.0) for i in range(150)]
    assert {r.cluster_id for r in found_groups(spark, rows).collect()} == {0}


def test_groups_without_rows_nulls_and_nan(spark):
    rows = [(i, 0.0, 0.0, -0.0 if i % 2 else 0.0) for i in range(6)] + [(10, None, 0.0, 0.0), (11, float("nan"), 0.0, 0.0), (12, 3.0, 3.0, 3.0)]
    assert {(r.feature_id, r.cluster_id, r.size) for r in found_groups(spark, rows).collect()} == {(i, 0, 6) for i in range(6)}
    assert found_groups(spark, []).count() == 0


def test_described_members(spark):
    rows = [(i, 0.01 * i, 0.0, 0.0, "clash", "clash") for i in range(9)] + [(100 + i, 5.0 + 0.01 * i, 0.0, 0.0, "clash", "clash") for i in range(5)]
    got = {r.community: r for r in clusters.described(spark.createDataFrame(rows, FZ), "feature_id", ("a", "b", "c"), 0.2, 5).collect()}
    assert got[0].size == got[0].cluster_size == 9 and got[100].size == 5 and len(got[0].typical) == 3 and set(got[100].typical) <= set(range(100, 105))
    assert clusters.described(spark.createDataFrame([], FZ), "feature_id", ("a", "b", "c"), 0.2, 5).count() == 0


def blobs(rng, n=60):
    """Three dense blobs; the first two are joined by a thin chain, so they are one group of two communities."""
    at = [(0.0, 0.0, 0.0), (1.2, 0.0, 0.0), (5.0, 5.0, 5.0)]
    rows = [(i, *[c + rng.uniform(-0.25, 0.25) for c in at[i % 3]]) for i in range(3 * n)]
    return rows + [(1000 + i, 0.15 * i, 0.0, 0.0) for i in range(9)]


def modularity(edges, label):
    total = sum(edges.values())
    inside, degree = defaultdict(float), defaultdict(float)
    for (u, v), w in edges.items():
        degree[label[u]] += w
        inside[label[u]] += w * (label[u] == label[v])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def test_communities_reach_a_modularity_that_no_merger_raises(spark):
    rows = blobs(random.Random(4))
    nodes = written(cells_of(spark.createDataFrame(rows, "id long, p0 double, p1 double, p2 double"), 0.2), "nodes")
    graph = written(clusters.neighbour_graph(nodes, 0.2, written), "graph")
    label = {r.id: r.c for r in clusters.communities(nodes, graph, 0.2, written).collect()}
    n = {r.id: r.n for r in nodes.collect()}
    edges = {(r.u, r.v): n[r.u] * n[r.v] * math.exp(-r.d2 / 0.01) for r in graph.collect()}
    edges |= {(u, u): k * (k - 1) * math.exp(-0.04 / 6 / 0.01) for u, k in n.items() if k > 1}
    got = modularity(edges, label)
    assert got > 0.5 and len(set(label.values())) > 2
    pairs = {tuple(sorted((label[u], label[v]))) for u, v in edges if label[u] != label[v]}
    for a, b in pairs:
        assert modularity(edges, {k: a if c == b else c for k, c in label.items()}) <= got + 1e-9
    one_each = modularity(edges, {k: k for k in label})
    assert got > one_each


def test_the_graph_saves_comparisons(spark):
    """Without the graph's links, ``links_across`` has many cells to compare; with them, next to none."""
    rng = random.Random(5)
    records = written(spark.createDataFrame([(i, *[rng.gauss(0, 0.3) for _ in range(3)]) for i in range(1500)], "id long, p0 double, p1 double, p2 double"), "r")
    nodes = written(cells_of(records, 0.2), "nodes")
    graph = written(clusters.neighbour_graph(nodes, 0.2, written), "graph")
    linked = relabelled(nodes.select("id", F.col("id").alias("c")), graph.select(F.col("u").alias("a"), F.col("v").alias("b")), written)
    apart = near_cells(nodes.withColumn("c", F.col("id")), 0.2).count()
    left = near_cells(nodes.join(linked, "id"), 0.2).count()
    assert left * 5 < apart


def test_neighbour_graph_recall(spark, sf):
    pts = written(points_of(spark.read.parquet(sf.replace("0.001", "0.01") + "/features_z.parquet"), "feature_id", queries.LIKENESS), "pts")
    graph = {(r.u, r.v) for r in clusters.neighbour_graph(pts, 0.2, written).collect()}
    xs = [(r.id, r.p0, r.p1, r.p2) for r in pts.collect()]
    hit = total = 0
    for a in xs:
        near = sorted((sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])), b[0]) for b in xs if b[0] != a[0])[: clusters.NEIGHBOURS]
        close = [v for d, v in near if d <= 0.04]
        total, hit = total + len(close), hit + sum((a[0], v) in graph for v in close)
    assert hit / total > 0.9


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), written).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))


# 8 -----------------------------------------------------------------------------------------------

ODD = [
    None, "", " ", "   \n\t ", "Hello world's end, isn't it?", "naïve café", "naïve decomposed", "日本語のテキスト", "🙂🙃 emoji 👩‍👩‍👧", "1234567890 12.5 %", "  leading", "trailing  ", "a b c　d",
    "<|endoftext|> is text", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "xxxxx xxxx", "http://a.b/c?d=e&f", "\x00\x01\x02", "ſ ǅ ⅷ ½ ²", "ZZZZZZZQQQQQ", "don’t “quote” – dash",
]


def test_ids_are_those_of_the_tokenizer(spark, exact):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aeiounstr bcdéñ,.\n1 ") for _ in range(rng.randrange(300))) for _ in range(80)] + ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(200)) for _ in range(20)] + ["Hello"] * 3
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(docs(spark, texts), "doc_id", "text").collect()}
    assert got == {i: exact.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_very_long_words_and_texts(spark, exact):
    texts = ["ab" * 30_000, "x" * 20_000, "word " * 60_000]
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(docs(spark, texts), "doc_id", "text").collect()}
    assert all(got[i] == exact.encode_ordinary(t) for i, t in enumerate(texts))
    assert tokens.token_ids(docs(spark, []), "doc_id", "text").count() == 0


def test_most_words_need_no_merging(exact):
    enc = tokens.Encoder(tokens.vocabulary_path())
    words = [" the", " parliament", "isation", " unbelievable", " Haushaltsausschuss", " zzzxq", " amendement", " tokenization"]
    enc.learn(words)
    assert [enc.words[w] for w in words] == [exact.encode_ordinary(w) for w in words] and enc.merged < enc.proposed


def test_forgetting_keeps_the_result(spark, exact, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.Encoder(tokens.vocabulary_path())
    import pyarrow as pa

    out = enc.encode(pa.array([["a", " b", " c", " d", "a"], None, [], ["a"]], pa.list_(pa.string()))).to_pylist()
    assert out == [[exact.encode_ordinary(w)[0] for w in ("a", " b", " c", " d", "a")], [], [], exact.encode_ordinary("a")]


# 9 -----------------------------------------------------------------------------------------------

def packed(spark, sizes, capacity=64):
    df = spark.createDataFrame([(i, n, 7) for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container_id int")
    return packing.pack(written(df, "sizes"), "doc_id", "n_tokens", capacity).collect()


def checked(rows, sizes, capacity=64):
    by, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece, r.token_start, r.n_tokens))
        if r.container_id is None:
            assert r.n_tokens == 0 and r.container_start is None
        else:
            by[r.container_id].append((r.container_start, r.n_tokens))
    for places in by.values():
        at = 0
        for start, n in sorted(places):
            assert start == at
            at += n
        assert at <= capacity
    for i, n in enumerate(sizes):
        n = n or 0
        got = sorted(parts[i])
        assert sum(x[2] for x in got) == n and (len(got) == 1 if n <= capacity else all(x[2] == capacity for x in got[:-1]))
        assert [x[1] for x in got] == [capacity * k for k in range(len(got))]
    return len(by)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    sizes = [min(300, int(rng.lognormvariate(2.5, 1.2))) for _ in range(600)] + [0, None, 64, 65, 128]
    n = checked(packed(spark, sizes), sizes)
    assert n <= 1.03 * -(-sum(x or 0 for x in sizes) // 64) + 1


def test_packing_edges(spark):
    assert packed(spark, []) == []
    assert checked(packed(spark, [None, 0]), [None, 0]) == 0
    same = [33] * 50
    assert checked(packed(spark, same), same) == 50
    half = [32] * 51
    assert checked(packed(spark, half), half) == 26


def test_kinds_hold_the_histogram_exactly():
    rng = random.Random(2)
    h = Counter(rng.randrange(1, 2049) for _ in range(5000))
    used = Counter()
    for kind, count in packing.plan_kinds(dict(h), 2048):
        assert sum(k * n for k, n in kind.items()) <= 2048 and count > 0
        for k, n in kind.items():
            used[k] += n * count
    assert used == h


# 10 ----------------------------------------------------------------------------------------------

CASES = [
    "Thank you, {{ speaker }}, for this.", "${date}", "The Minister [INSERT NAME HERE] replied.", "*** Text folgt ***", "Wir %(partei)s danken.", "[[date à préciser]]", "@@SPEAKER@@ spoke.", "__insertar texto aquí__",
    "Lorem ipsum dolor amet venostra tempor.", "Text text text text.", "A real speech. It ends.\nThis is placeholder copy for layout purposes only.", "Body copy goes here. Body copy goes here.",
    "404 Not Found", "Error 500: página no encontrada", "Service Unavailable (503)", "A real speech.\n\nInterner Serverfehler. Vorgang 12ab.", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nKeyError: 'x'",
    "<html><head><title>Oops</title></head></html>", "ACCÈS REFUSÉ. RÉFÉRENCE F0", "fehler 410: seite nicht gefunden",
    "Please enable JavaScript to view this transcript.", "  Su  navegador  tiene  JavaScript  desactivado.", "Honourable Members.\nCette page nécessite l’exécution de scripts.", "Ihr Browser unterstützt kein Java-\nScript.",
]
SPEECH = [
    None, "", "   ", "The notice still read “Error 500” when it reached us.", "I quote: “{{ name }}”. Nothing else.", "Je cite le projet : « Veuillez activer JavaScript ».", "Auf dem Formular stand „[[Name des Redners einfügen]]“.",
    "Citizens who switch off JavaScript cannot file a petition at all.", "The so-called strategy is lorem ipsum with a foreword.", "Access denied, page not found, try again later: that is daily bread.", "[Laughter] {inaudible} <laughter> And yet!",
    "We were told the server had an internal error; I call it an internal error of this Government.", "The figure {sic} in table 2 and $ 40 per 100 % of output [3].", "Those in favour? Those against? The amendment is carried.", "(Applause) No, no, no! Hear, hear!",
]


#: Bodies as they recur in a corpus: under three addresses each, between speeches that say other things.
USUAL = [f"I thank the rapporteur for the report on {x}. We in this House have waited {i} months for it, and the people of our towns ask why." for i, x in enumerate("ferries tolls peat salt mills quays bees dams".split())]


def speeches(spark, texts, copies=1, usual=5):
    rows = [(i, t, "plenary", f"AI-{i}-{c}", "Debate on harbour dredging", "clash") for i, t in enumerate(texts) for c in range(copies)]
    rows += [(1000 + i, t, "committee", f"AI-{1000 + i}", "Debate on harbour dredging", "clash") for i, t in enumerate(USUAL * usual)]
    return spark.createDataFrame(rows if texts else [], "doc_id long, text string, source string, agenda_id string, agenda_item string, body string")


def test_residue_is_found_and_speech_is_not(spark):
    got = {r.doc_id for r in residue.residue(speeches(spark, CASES + SPEECH, 3), written).collect()}
    assert got == set(range(len(CASES))), [(CASES + SPEECH)[i] for i in got ^ set(range(len(CASES)))]
    assert residue.residue(speeches(spark, []), written).count() == 0


def flagged(spark, texts, flag, copies=1, usual=5):
    return {r.doc_id for r in residue.residue(speeches(spark, texts, copies, usual), written).where(flag).collect()}


def test_dummy_text_of_an_unseen_vocabulary(spark):
    rng = random.Random(3)
    own = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(25)]
    dummy = [". ".join(" ".join(rng.choices(own, k=7)).capitalize() for _ in range(5)) + "." for _ in range(3)]
    assert flagged(spark, [*dummy, "A speech of ours.\n" + dummy[0]] + USUAL, "is_filler", usual=300) == {0, 1, 2, 3}


def test_an_unlisted_sentence_that_repeats_itself_everywhere_is_filler(spark):
    texts = ["Gemora tal nuvent oris. " * n for n in (3, 5, 4)] + ["Gemora tal nuvent oris.", "We agree with that. We agree with that."] + ["We agree with that."] * 9
    assert flagged(spark, texts, "is_filler") == {0, 1, 2, 3}


def test_responses_need_the_evidence_of_the_corpus(spark):
    """The same body is a response where it recurs under other addresses, and none under one address or where its terms are the title's."""
    once = "The archive server refused this. A second point. A third one, and a fourth. We go on. And we end."
    assert flagged(spark, [once], "is_canned") == set()
    assert flagged(spark, [once] * 3, "is_canned") == {0, 1, 2}
    titled = "Harbour dredging server refused."
    assert flagged(spark, [titled + " We go on. And so we end. We do. We really do."] * 3, "is_canned") == set()


def test_very_long_texts(spark):
    speech = "I thank the rapporteur for his report on harbour dredging. " * 20_000
    got = {r.doc_id for r in residue.residue(speeches(spark, [speech, speech + "{{ party }}", "“" + "a" * 100_000, speech + "\nYour session has expired."]), written).collect()}
    assert got == {1, 3}


def test_unlisted_responses_that_recur_under_other_addresses(spark):
    canned = "Login cache failure on this webmaster url"
    texts = [canned + f" {i}" for i in range(4)] + ["A cache failure at the url of our minister"] * 4
    assert flagged(spark, texts, "is_canned") == {0, 1, 2, 3}


def test_repeated_doc_ids_and_null_columns(spark):
    rows = [(1, "404 Not Found", None, None, None), (1, "A speech.", None, None, None), (2, "A speech.", "x", None, None), (None, "{{ name }}", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, agenda_id string, agenda_item string")
    assert {r.doc_id for r in residue.residue(df, written).collect()} == {1, None}


def test_queries_run_on_the_smallest_tables(spark, sf):
    for name, f in queries.QUERIES.items():
        assert f(spark, sf).limit(3).count() >= 0, name
    assert dt is not None and F is not None
