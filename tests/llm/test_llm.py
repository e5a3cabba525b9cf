"""The corpus operators on small inputs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, scanned, subjects, tokens

# --- scanned pages ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [("- 12 -", (12, True)), ("— 3 —", (3, True)), ("p. 177", (177, True)), ("Page 6 0f 18", (6, True)), ("8/25", (8, True)), ("7 | 11", (7, True)), ("第 3 页 共 9 页", (3, True)), ("第3页", (3, True)), ("xiv", (14, False)), ("42", (42, False)), ("1O", (10, False)), ("the", None), ("iiii", None), ("", None)],
)
def test_page_numbers(text, want):
    assert scanned.page_number(text) == want


def pages():
    """Two works with running titles, page numbers, broken words and misread characters."""
    body = [
        "The register was checked before the pipeline stopped. Nobody expected the",
        "register to outlast the pipeline. The low-cost register was checked again.",
        "Each pipeline follows the register in this chapter, as everybody knows well.",
    ]
    rows = []
    for n in range(1, 13):
        lines = ["NOTES ON PIPELINES", f"- {n} -", "", *body]
        if n == 3:
            lines += ["We looked at the reg-", "ister and at the low-", "cost pipeline, 0nce.", "The pipel1ne and the rcgister stopped. Check 42 of v17."]
        if n == 4:
            lines += ["On this page the pipe¬"]
        if n == 5:
            lines[2:2] = ["line went on."]
        if n == 6:
            lines += ["", "A Heading Here", "", "1234", "", *body]
        rows.append((f"i{n}", "w", n, "\n".join(lines)))
    zh = "如果模块出现问题，请先检查缓存。这份说明共有三行，作者感谢各位读者。"
    for n in range(1, 31):
        rows.append((f"z{n}", "zh", n, "\n".join([f"第{n}页   接口讲义", "", zh, zh.replace("如果", "如呆") if n == 7 else zh, f"这一条写了{n * 37}行。"])))
    rows += [("e1", "w", 90, None), ("e2", "w", 91, ""), ("e3", None, None, " \n "), ("i3", "w", 3, rows[2][3])]
    return rows


def test_repairs(spark):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "image_id string, media_id string, item_index int, ocr_text string, line_no string")
    got = [tuple(r) for r in scanned.repairs(df).collect()]
    assert len(got) == len(set(got))
    by = defaultdict(set)
    for image, line, kind, repaired in got:
        by[kind].add((image, line, repaired))
    assert by["hyphen"] == {("i3", 7, "register"), ("i3", 8, "low-cost"), ("i4", 7, "pipeline")}
    assert by["misread"] == {("i3", 10, "pipeline"), ("i3", 10, "register"), ("z7", 4, "果")}
    numbers = {(f"i{n}", 2, "") for n in range(1, 13)}
    heads = {(f"i{n}", 1, "") for n in range(1, 13)} | {(f"z{n}", 1, "") for n in range(1, 31)}
    assert by["furniture"] == numbers | heads


def test_paragraphs(spark):
    """Planted damage comes back letter for letter, over lines, pages and blocks of pages."""
    pages_, want = [], []
    chapters = ["NOTES ON PIPELINES", "NOTES ON PIPELINES"]
    sentence = "The register was checked before the pipeline stopped, and nobody expected the register to outlast the low-cost pipeline."
    for n in range(1, 41):
        lines = [chapters[n % 2], f"- {n} -", ""]
        if n == 1:
            lines += ["The register was checked before the pipe-", "line stopped, and nobody expected the rcgister", "to outlast the low-", "cost pipel1ne.", ""]
        if n == 2:
            lines += ["The register was checked before the pipeline stopped, and nobody expected the reg-"]
            pages_.append(("i2", "w", 2, "\n".join(lines)))
            continue
        if n == 3:
            lines += ["ister, to outlast the low-cost pipeline.", ""]
        lines += ["The register was checked before the pipeline", "stopped, and nobody expected the register to", "outlast the low-cost pipeline."]
        pages_.append((f"i{n}", "w", n, "\n".join(lines)))
    want = [(1, sentence), (1, sentence), (2, sentence.replace("the register to", "the register, to"))] + [(n, sentence) for n in range(3, 41)]
    zh = "如果模块出现问题，请先检查缓存。这份说明共有三行，作者感谢各位读者。"
    pages_ += [(f"z{n}", "zh", n, "\n".join([f"第{n}页   接口讲义", "", zh[:20], zh.replace("如果", "如呆")[20:] if n == 7 else zh[20:], "", f"这一条写了{n * 37}", "行。"])) for n in range(1, 31)]
    pages_ += [("e1", "w", 90, None), ("e2", "w", 91, ""), ("e3", None, None, " \n "), ("e4", None, None, "Alone")]
    df = spark.createDataFrame([(*r, 1) for r in pages_], "image_id string, media_id string, item_index int, ocr_text string, page int")
    got = scanned.paragraphs(df).collect()
    work = lambda m: [(r.first_page, r.text) for r in sorted(got, key=lambda r: r.paragraph_no) if r.media_id == m]
    assert work("w") == want
    assert work("zh") == [(n, t) for n in range(1, 31) for t in (zh, f"这一条写了{n * 37}行。")]
    assert work("") == [(0, "Alone")] and {r.media_id for r in got} == {"w", "zh", ""}
    assert [r.paragraph_no for r in sorted(got, key=lambda r: r.paragraph_no) if r.media_id == "w"] == list(range(1, len(want) + 1))
    assert scanned.paragraphs(df.limit(0)).count() == 0


def test_paragraphs_go_on_over_blocks_of_pages(spark, monkeypatch):
    monkeypatch.setattr(scanned, "PAGE_BLOCK", 3)
    df = spark.createDataFrame([(f"i{n}", "w", n, f"and so it went on in line {n} of the text") for n in range(1, 12)], "image_id string, media_id string, item_index int, ocr_text string")
    assert [(r.paragraph_no, r.text.count("line")) for r in scanned.paragraphs(df).collect()] == [(1, 11)]


def test_furniture_behind_many_short_lines(spark):
    """A page number is found however many titles stand between it and the page's edge."""
    rows = [(f"i{n}", "w", n, "\n".join(["Part One", "On Registers", "And Pipelines", "By Nobody", f"- {n} -", "", "The register was checked before the pipeline stopped."])) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "image_id string, media_id string, item_index int, ocr_text string")
    assert {(r.image_id, r.line_no) for r in scanned.repairs(df).where("kind = 'furniture' and line_no = 5").collect()} == {(f"i{n}", 5) for n in range(1, 9)}


def test_repairs_of_nothing(spark):
    schema = "image_id string, media_id string, item_index int, ocr_text string"
    assert scanned.repairs(spark.createDataFrame([], schema)).count() == 0
    assert scanned.repairs(spark.createDataFrame([("a", "m", 1, None)], schema)).count() == 0
    assert scanned.repairs(spark.createDataFrame([("a", "m", 1, "x" * 200_000), ("b", None, None, "word")], schema)).count() == 0


def test_every_character_of_a_window_can_be_meant(spark):
    """果 is only the twelfth of the characters between 前 and 后, and still what 杲 was read for."""
    fillers = "天地山水火木金石田土风"
    texts = ["前杲后"] * 2 + ["前果后"] * 30 + [f"{a}{c}{b}" for c in fillers for a, b in ("前后", "左右") for _ in range(40)]
    rows = [(f"z{k}", 0, t) for k, t in enumerate(texts)]
    found = scanned.misread_characters(spark.createDataFrame(rows, "image_id string, line_no int, zh string"))
    assert {(r.image_id, r.at, r.ch, r.right) for r in found.collect()} == {("z0", 1, "杲", "果"), ("z1", 1, "杲", "果")}


def test_variants_join_by_value(spark):
    rare = spark.createDataFrame([("cheek", 1), ("modern", 2), ("ehekc", 1)], "word string, n long")
    often = spark.createDataFrame([("check", 90), ("modem", 50), ("keche", 70)], "word string, n long")
    confusions = spark.createDataFrame(scanned.CONFUSIONS, "wrong string, true string")
    got = {(r.word, r.right) for r in scanned.confusable_variants(rare, often, confusions).collect()}
    assert got == {("cheek", "check"), ("modern", "modem")}


# --- packing ---------------------------------------------------------------------------


def slow_best_fit(sizes, clusters, sources, capacity, conflicts):
    bins, where = [], {}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i]))
    for i in order:
        fits = [b for b, (left, cs, ss) in enumerate(bins) if left >= sizes[i] and (clusters[i] < 0 or clusters[i] not in cs) and not any(conflicts.get(sources[i], 0) >> s & 1 for s in ss)]
        if fits:
            b = min(fits, key=lambda b: bins[b][0])
            bins[b] = (bins[b][0] - sizes[i], bins[b][1] | {clusters[i]}, bins[b][2] | {sources[i]})
        else:
            b = len(bins)
            bins.append((capacity - sizes[i], {clusters[i]}, {sources[i]}))
        where[i] = b
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit(seed):
    random.seed(seed)
    n, capacity = random.choice([1, 30, 300]), random.choice([10, 64])
    conflicts = {} if seed % 3 else {0: 2, 1: 1}
    cluster_size = {c: random.randint(1, capacity) for c in range(6)}
    clusters = [random.choice([-1, -1, 0, 1, 2, 3, 4, 5]) for _ in range(n)]
    sizes = [cluster_size[c] if c >= 0 else random.randint(1, capacity) for c in clusters]
    source_of = {c: c % 3 for c in range(6)}
    sources = [source_of[c] if c >= 0 else random.randrange(3) for c in clusters]
    where = packing.best_fit(sizes, clusters, sources, capacity, conflicts)
    used, held, kinds = Counter(), defaultdict(list), defaultdict(set)
    for i, b in enumerate(where):
        used[b] += sizes[i]
        held[b].append(clusters[i])
        kinds[b].add(sources[i])
    assert max(used.values()) <= capacity
    assert all(len([c for c in cs if c >= 0]) == len({c for c in cs if c >= 0}) for cs in held.values())
    assert not conflicts or all(not {0, 1} <= k for k in kinds.values())
    assert len(used) <= slow_best_fit(sizes, clusters, sources, capacity, conflicts) * 1.05 + 1


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 200)
    random.seed(4)
    rows = [(n, random.choice(["a", "b", None]), random.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000]) if n % 3 else 7, n % 3 and n or 1) for n in range(1500)]
    rows.append((9999, None, None, 3))
    items = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, cluster long, capacity string")
    limits = spark.createDataFrame([("s", 100), ("m", 1000), ("none", None), ("zero", 0)], "limit_name string, capacity_tokens int")
    out = packing.pack(items, limits).collect()
    for name, capacity in (("s", 100), ("m", 1000)):
        per, doc, parts = Counter(), Counter(), Counter()
        texts = defaultdict(list)
        for r in (r for r in out if r.limit_name == name):
            per[r.container_id] += r.n_tokens
            doc[r.doc_id] += r.n_tokens
            parts[r.doc_id] += 1
            texts[r.container_id].append(r.doc_id)
        assert max(per.values()) <= capacity
        assert doc == {d: t for d, _, t, _ in rows if t}
        assert all(parts[d] == -(-t // capacity) for d, _, t, _ in rows if t)
        assert all(sum(d % 3 == 0 for d in ds) <= 1 for ds in texts.values())  # copies of one text stand apart
    assert {r.limit_name for r in out} == {"s", "m"}
    assert packing.pack(items.limit(0), limits).count() == 0


def test_pack_in_rounds_keeps_sources_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 100)
    monkeypatch.setattr(packing, "MERGED_GROUPS", 2)
    random.seed(6)
    rows = [(n, random.choice("abc"), random.randint(1, 99), n) for n in range(1200)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, cluster long")
    out = packing.pack(items, spark.createDataFrame([("s", 100)], "limit_name string, capacity_tokens int"), [("a", "b")]).collect()
    source, size, held = {r[0]: r[1] for r in rows}, Counter(), defaultdict(set)
    for r in out:
        size[r.container_id] += r.n_tokens
        held[r.container_id].add(source[r.doc_id])
    assert sorted(r.doc_id for r in out) == list(range(1200)) and max(size.values()) <= 100
    assert not any({"a", "b"} <= s for s in held.values())
    assert len(size) <= 1.05 * sum(r[2] for r in rows) / 100


# --- mixing -----------------------------------------------------------------------------


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_TEXTS", 50)
    random.seed(5)
    rows = [(n, "big" if n % 10 else "small", random.randint(1, 200)) for n in range(6000)] + [(7000, "big", 0), (7001, None, 5), (7002, "other", 5), (7003, "big", None)]
    items = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, range string")
    targets = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.4, 3), ("n", "big", 0.5, 1), ("n", "gone", 0.5, 9), (None, "big", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix(items, targets)
    uses = {(r.mix_name, r.doc_id): r.uses for r in got.collect()}
    assert max(u for (m, d), u in uses.items() if m == "m" and d % 10) <= 2 and max(u for (m, d), u in uses.items() if m == "m" and not d % 10) == 3
    size = Counter()
    for d, s, n in rows:
        for m in ("m", "n"):
            size[m, s] += (n or 0) * uses.get((m, d), 0)
    assert abs(size["m", "big"] / (size["m", "big"] + size["m", "small"]) - 0.6) < 0.002
    assert size["n", "big"] == sum(n or 0 for _, s, n in rows if s == "big")
    report = {(r.mix_name, r.source): r for r in mixing.share_report(got, targets).collect()}
    assert report["n", "gone"].tokens == 0 and abs(report["m", "small"].actual_share - 0.4) < 0.002
    assert {(r.mix_name, r.doc_id, r.uses) for r in mixing.mix(items, targets).collect()} == {(m, d, u) for (m, d), u in uses.items()}
    assert mixing.mix(items.limit(0), targets).count() == 0 and mixing.mix(items, targets.limit(0)).count() == 0


def test_prefix_sums_cut_where_a_plain_sort_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_TEXTS", 10)
    rows = [(n, s, 1 + n % 7) for n in range(900) for s in ("a", "b") if (n % 3 == 0) == (s == "b")]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    keyed = items.withColumn("key", F.xxhash64("doc_id", F.lit(20260101))).where("source = 'a'").orderBy("key", "doc_id").collect()
    budget, start, want = sum(n for _, s, n in rows if s == "b"), 0, set()
    for r in keyed:
        if 2 * start + r.n_tokens <= 2 * budget:
            want.add(r.doc_id)
        start += r.n_tokens
    assert {r.doc_id for r in mixing.mix(items, targets).where("source = 'a'").collect()} == want


# --- tokens -------------------------------------------------------------------------------


def test_tokens(spark):
    enc = tokens.encoding()
    texts = ["Some words, and 3 numbers.", "模块与接口", "", " \n\n x", "<|endoftext|>", "é" * 300]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)} | {99: 0}


# --- subjects -------------------------------------------------------------------------------


def test_sentences():
    text = "# Head\n\nOne is here. Two is there!\n\n```\ncode. Code.\n```\n| a | b |\n- An item of it.\n1. Next one\n[00:06] It began At first, it ended\nUser: Why so?\n如果出错，请先检查。我们比较了它，它最突出。"
    assert subjects.sentences(text) == ["One is here.", "Two is there!", "An item of it.", "Next one", "It began", "At first, it ended", "Why so?", "如果出错，请先检查。", "我们比较了它，它最突出。"]
    assert subjects.sentences(None) == subjects.sentences("") == subjects.sentences(" \n") == []
    opening = {"t说明": 2.0, "h我们比": 1.0, "t例子": -3.0, "h它最突": -1.0}
    assert subjects.sentences("作者没有说明，我们比较了例子，它最突出", opening) == ["作者没有说明", "我们比较了例子，它最突出"]


def test_subjects(spark, small):
    """Held-out passages get their area; passages without one get none."""
    examples = spark.read.parquet(f"{small}/../sf0.01/subject_example.parquet")
    corpus = spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("doc_id", "text")
    held = [(-r.example_id - 1, r.sample_text, r.area) for r in examples.where("example_id % 4 = 0").collect()]
    neutral = [(-1000, "The comparison was added again. Please read the example before the second remark.", None), (-1001, None, None), (-1002, "  ", None), (-1003, "```\nthe linter parsed\n```", None)]
    more = spark.createDataFrame([(i, t) for i, t, _ in held + neutral], "doc_id long, text string")
    got = subjects.subject_areas(corpus.unionByName(more).withColumn("terms", F.lit("x")), examples.where("example_id % 4 <> 0"))
    found = {(r.doc_id, r.area) for r in got.where("doc_id < 0").collect()}
    right = sum((i, a) in found for i, _, a in held)
    assert right >= 0.9 * len(held)
    assert len(found - {(i, a) for i, _, a in held}) <= 0.1 * len(held)
    assert not any(i <= -1000 for i, _ in found)


def test_subjects_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    examples = spark.createDataFrame([("law", "The court upheld the claim."), (None, "x"), ("law", None)], "area string, sample_text string")
    assert subjects.subject_areas(none, examples).count() == 0
    assert subjects.subject_areas(spark.createDataFrame([(1, "Some text here.")], "doc_id long, text string"), examples.limit(0)).count() == 0
