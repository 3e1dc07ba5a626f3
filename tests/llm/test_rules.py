import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import quality, queries, sql, urls

DOC = "doc_id long, text string, source string, kept string, n_words string, removed_words string"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n ", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z x y z x y\nx y z", "l\nl\n \nl\n\nm", "#*$%&|<> é漢 😀", "a\x0bb\x0cc\rd", "ab c a bc a b c", "w " * 20_000,
    " ".join(f"w{k}" for k in range(20_000)), "\n".join(["same line of text here"] * 30), "one two\n" * 3 + "three",
]


def test_base_features(spark):
    frame = spark.createDataFrame([(k, t, "s", "k", "n", "r") for k, t in enumerate(TEXTS)], DOC)
    got = {r.doc_id: r for r in quality.judge(frame).collect()}
    for k, t in enumerate(TEXTS):
        want = brute_base(t)
        assert tuple(got[k][f] for f in quality.FEATURES) == want, t
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert set(frame.columns) <= set(got[0].asDict())


def unique(k, n=60):
    """Words in letters only: texts that differ in digits alone have equal normalised lines."""
    return " ".join(f"word{k}x{j}" for j in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_line_frequency(spark):
    common = "Read our Terms and 3 conditions"
    rows = [(k, f"{unique(k)}\n{common.upper().replace('3', str(k % 9))}", "a") for k in range(20)]
    rows += [(100 + k, "\n".join([unique(k, 15), *[f"line {w} of the footer" for w in ("one", "two", "three")] * 4]), "a") for k in range(20)]
    rows += [(200 + k, f"{unique(1000)}\ncopied text", None) for k in range(30)]
    rows += [(300, unique(300) + "\n" + common, "b"), (0, rows[0][1], "a")]
    frame = spark.createDataFrame([(*r, "k", "n", "r") for r in rows], DOC)
    got = quality.judge(frame, share=0.1, keep=0.5).collect()
    by = {(r.doc_id, r.source): r for r in got}
    assert len(got) == len(rows)
    assert all(by[k, "a"].removed_words == 6 and by[k, "a"].kept for k in range(20))
    assert all(by[100 + k, "a"].removed_words == 60 and not by[100 + k, "a"].kept for k in range(20))
    assert all(by[200 + k, None].kept for k in range(30)), "exact copies are one document"
    assert by[300, "b"].removed_words == 0


def test_shared_lines_in_small_and_hot_sources(spark):
    """With production values: six of 40 texts in a small source; 101 and 100 of 6000 in a hot one full of copies."""
    line = {k: f"the {k} footer of this site stands here" for k in ("small", "rare", "hot", "under")}
    rows = [(k, unique(k) + ("\n" + line["small"]) * (k < 6) + ("\n" + line["rare"]) * (k < 5), "small") for k in range(40)]
    rows += [(1000 + k, unique(1000 + k, 51) + ("\n" + line["hot"]) * (k < 101) + ("\n" + line["under"]) * (k < 100), "hot") for k in range(6000)]
    rows += [(9000 + k, unique(1000, 51) + "\n" + line["hot"] + "\n" + line["under"], "hot") for k in range(3000)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(*r, "k", "n", "r") for r in rows], DOC)).collect()}
    assert {k for k in got if got[k].removed_words} == {*range(6), *range(1000, 1101), *range(9000, 12000)}
    assert {got[k].removed_words for k in (0, 1000, 9000)} == {8} and all(r.kept for r in got.values())


def test_quality_rules_remove_lines_of_the_table(spark):
    got = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").where("removed_words > 0").collect()
    assert len(got) > 50


def test_quality_keeps_columns_of_any_name(spark):
    names = "key copy host at hash words line row id lost_words lost_copy lost_host bad_host bad_hash of_words docs all_docs host_name __copy x".split()
    rows = [(k, unique(k) + "\nthe line of all of them", "s", *[f"{c}{k}" for c in names]) for k in range(9)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", {c} string" for c in names))).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "text", "source", *names)) for r in got) == rows and {r.removed_words for r in got} == {6}


def test_quality_empty(spark):
    assert quality.judge(spark.createDataFrame([], DOC)).count() == 0


def test_quality_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    frame = queries.op3_quality_rules(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql.ORACLES['op3_quality_rules']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)


PAGE = "page_id long, url string, host string, verdict string"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [
    None, "", "no scheme", "http://", "://x", "http://A.Net/x", "http://net", "http://xnet/", "http://example.net/en/1", "http://EXAMPLE.net/en", "https://a.example.com/de/x?y#z", "https://example.com/DE/", "http://b.org/fr/",
    "http://b.org?q=/fr/", "ftp://u:p@h.org:80/fr/x://y", "http://h/a\nb/c", "http://h/é/漢", "http://example.com/de/" + "x/" * 9000, "http://net.com/", "http://Ä.net/",
]


def test_url_rules(spark):
    frame = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)] + [(0, None, "h", "v")], PAGE)
    got = urls.judge(frame).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or "allow")
    assert urls.judge(spark.createDataFrame([], PAGE)).count() == 0


def test_template_tree_finds_bad_branch(spark):
    rows = [(k, f"http://shop.test/{part}/{k}/item-{k}.html", "h", "v") for k in range(200) for part in [("spam", "news", "docs", "blog")[k % 4]]]
    rows += [(1000 + k, f"http://other.test/p/{k}", "h", "v") for k in range(20)]
    labels = spark.createDataFrame([(k, k % 4 == 0) for k in range(0, 160)] + [(0, False), (5000, True)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGE), labels).collect()}
    assert {got[k].verdict for k in range(0, 200, 4)} == {"block"} and {got[k].template for k in range(0, 200, 4)} == {"/spam/*/*"}
    assert {got[k].verdict for k in range(200) if k % 4} == {"allow"}
    assert {got[1000 + k].template for k in range(20)} == {"/*/*"}


def brute_shape(path):
    out = re.sub(r"(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f]{8,}(-[0-9a-f]{4,})*(?![0-9a-z])", "{hex}", path)
    return [s for s in re.sub("[0-9]+", "{num}", out).split("/") if s]


def brute_tree(rows, labels):
    """page -> (template, purity) by trees of nested dictionaries, a host at a time."""
    parsed = {}
    for page, url in rows:
        host, path, _, verdict = brute_rule(url)
        parsed[page] = (host, tuple(brute_shape(path)), {"block": 1, "allow": 0}.get(verdict, labels.get(page)))
    template = {}

    def walk(host, prefix, depth, own):
        """``own``: (shape, label) of the pages whose paths took the steps of ``prefix``."""
        children = {}
        for shape, bad in own:
            if len(shape) <= depth:
                template[host, shape] = prefix
            elif depth == urls.DEPTH:
                template[host, shape] = f"{prefix}/*"
            else:
                children.setdefault(shape[depth], []).append((shape, bad))
        every = [b for v in children.values() for _, b in v if b is not None]
        pages, rate, groups = sum(map(len, children.values())), sum(every) / len(every) if every else None, {}
        for name, v in children.items():
            told = [b for _, b in v if b is not None]
            differs = rate is not None and abs(sum(told) - len(told) * rate) > urls.Z * math.sqrt(len(told) * rate * (1 - rate))
            alone = differs and (len(told) >= urls.MIN_LABELS or len(v) >= urls.SUPPORT * pages)
            groups.setdefault(name if alone else "*", []).extend(v)
        for name, v in groups.items():
            walk(host, f"{prefix}/{name}", depth + 1, v)

    hosts = {}
    for host, shape, bad in parsed.values():
        hosts.setdefault(host, []).append((shape, bad))
    for host, own in hosts.items():
        walk(host, "", 0, own)
    every = [b for _, _, b in parsed.values() if b is not None]
    base = (sum(every) + 1) / (len(every) + 2)
    host_rate = {}
    for host, own in hosts.items():
        told = [b for _, b in own if b is not None]
        host_rate[host] = (sum(told) + urls.SMOOTHING * base) / (len(told) + urls.SMOOTHING)
    of = {}
    for host, shape, bad in parsed.values():
        of.setdefault((host, template[host, shape]), []).append(bad)
    purity = {}
    for (host, t), v in of.items():
        told = [b for b in v if b is not None]
        purity[host, t] = (sum(told) + urls.SMOOTHING * host_rate[host]) / (len(told) + urls.SMOOTHING)
    return {page: (template[host, shape], purity[host, template[host, shape]]) for page, (host, shape, _) in parsed.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_template_tree_equals_nested_dictionaries(spark, seed):
    draw = random.Random(seed)
    hosts = ["a.test", "b.test", "x.net", "sub.example.com", "c.test"]
    words = ["spam", "news", "p", "item", "blog", "de", "x1", "0123abcd4567ef89", "archive"]
    rows = [(k, f"http://{draw.choice(hosts)}/" + "/".join(draw.choice(words) if draw.random() < 0.8 else str(draw.randrange(99)) for _ in range(draw.randrange(9)))) for k in range(900)]
    rows += [(1000, None), (1001, "no scheme")]
    bad_words = set(draw.sample(words, 2))
    labels = {k: int(any(f"/{w}" in (u or "") for w in bad_words) if draw.random() < 0.9 else draw.random() < 0.5) for k, u in rows if draw.random() < 0.5}
    want = brute_tree(rows, labels)
    frame = spark.createDataFrame([(*r, "h", "v") for r in rows], PAGE)
    got = urls.judge(frame, spark.createDataFrame([(k, bool(b)) for k, b in labels.items()], "page_id long, bad boolean")).collect()
    assert len({t for t, _ in want.values()}) > 20
    for r in got:
        template, purity = want[r.page_id]
        assert r.template == template and r.purity == pytest.approx(purity)
        assert r.verdict == (brute_rule(dict(rows)[r.page_id])[3] or ("block" if purity >= urls.REJECT else "allow"))


def test_url_filter_keeps_columns_of_any_name(spark):
    names = "row page told told_bad shape by_rule own_shape shape_host bad pages labelled b n host_rate child x".split()
    rows = [(k, f"http://h.test/{'bad' if k % 2 else 'good'}/{k}", *[f"{c}{k}" for c in names]) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string" + "".join(f", `{c}` string" for c in names))
    got = urls.judge(frame, spark.createDataFrame([(k, k % 2 == 1) for k in range(40)], "page_id long, bad boolean")).collect()
    assert sorted(tuple(r[c] for c in ("page_id", "url", *names)) for r in got) == rows
    assert {r.page_id for r in got if r.verdict == "block"} == {k for k in range(40) if k % 2}


def test_template_tree_keeps_small_branches_that_differ(spark):
    # 40 even sections, one of them bad, beside single bad pages.
    rows = [(k, f"http://hot.test/part{chr(97 + k % 40 // 20)}{chr(97 + k % 20)}/item-{k}", "h", "v") for k in range(1200)]
    rows += [(2000 + k, f"http://hot.test/lone{chr(97 + k)}/x", "h", "v") for k in range(4)]
    labels = spark.createDataFrame([(k, k % 40 == 7) for k in range(1200)] + [(2000 + k, True) for k in range(4)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGE), labels).collect()}
    bad = {k for k in range(1200) if k % 40 == 7}
    assert {k for k in range(1200) if got[k].verdict == "block"} == bad and {got[k].template for k in bad} == {"/partah/*"}
    assert {got[2000 + k].template for k in range(4)} == {"/*/*"}, "too few labels for a template of its own"


@pytest.mark.parametrize(("path", "shape"), [("/a//b/", "a/b"), ("/2024/05/x", "{num}/{num}/x"), ("/id/0123abcd4567ef89/z.html", "id/{hex}/z.html"), ("", ""), ("/", ""), ("/deadbeef", "deadbeef"), ("/v12.3", "v{num}.{num}")])
def test_typed_paths(spark, path, shape):
    from pyspark.sql import functions as F

    assert spark.range(1).select(urls.typed_path(F.lit(path))).first()[0] == shape


def test_url_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op5_url_filter(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.purity >= urls.REJECT else "allow"))
