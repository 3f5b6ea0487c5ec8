import random

from pyspark.sql import functions as F

from creditloom.llm import chat, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


def plain(url, rules):
    host, path = split_url(url)
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), -len(h), rule, verdict))
    return (host, path, *(min(fits)[2:] if fits else (None, "allow")))


def test_same_as_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "b", "net", "org", "x-y", "é"]
    pick = lambda n: [rng.choice(names) for _ in range(rng.randrange(1, n))]
    rules = {(".".join(pick(4)) + "/" + "/".join(pick(4)) + rng.choice(["", "/"])): rng.choice(["allow", "block"]) for _ in range(60)}
    rules |= {"net/": "block", "a.net/": "allow", "net/a": "allow"}
    pages = [
        f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(pick(5)).upper()}{rng.choice(['/', '', '?q', '#f/'])}{'/'.join(pick(5))}{rng.choice(['', '?a=/b', '#t'])}"
        for _ in range(600)
    ]
    pages += [None, "", "no scheme/net/", "http://", "x://net", "http://a.net/"] + ["http://q.a.net/b"] * 300
    rows = [(i if i % 50 else None, u) for i, u in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    judge = spark.createDataFrame([*rules.items(), *list(rules.items())[:3]], "rule string, verdict string")
    found = urls.judge_urls(frame, judge).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, found), key=key) == sorted(
        ((i, *plain(u, list(rules.items()))) for i, u in rows), key=key
    )


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")] * 2
    rules = spark.createDataFrame([("b/", "block")], "rule string, verdict string")
    assert urls.judge_urls(pages.limit(0), rules).collect() == []


def test_very_long_urls_and_other_columns(spark):
    """A host has as many keys as the longest rule has labels, however long it is."""
    assert len(urls.url_keys("x." * 100_000 + "a.net", "/", 3)) == 3
    hosts = ["x." * 100_000 + "a.net", "x." * 100_000 + "b.org", "a.net", "net", "q" * 300_000]
    rows = [(i, f"http://{h}/{'p/' * 50_000}", "k", "r") for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, rule string")
    rules = spark.createDataFrame([("a.net/p/", "block"), ("org/", "block"), ("net/", "allow")], "rule string, verdict string")
    found = urls.judge_urls(pages, rules)
    assert sorted((r["id"], r["rule"], r["verdict"]) for r in found.select("id", "rule", "verdict").collect()) == [
        (0, "a.net/p/", "block"),
        (1, "org/", "block"),
        (2, "a.net/p/", "block"),
        (3, "net/", "allow"),
        (4, None, "allow"),
    ]


def test_parts_attachments_and_loss(spark):
    part = lambda kind, **v: {"kind": kind, **v}
    rows = [
        (1, 1, "assistant", [part("text", text='<b> & "q" &lt;'), part("image", ref="i.png", width=28, height=15)]),
        (1, 0, "user", [part("document", ref="d.pdf", pages=3), part("text", text="see "), part("audio", ref="s.wav", seconds=1.5)]),
        (2, 0, None, None),
        (2, None, 'we"ird<', [part("odd kind/>", ref="z")]),
        (None, 5, "assistant", [part("text", text=None)]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    found = {r["id"]: r for r in chat.format_chats(frame).collect()}
    one = found[1]
    assert one["formatted"] == (
        '<turn role="user"><document/>see <audio/></turn>\n'
        '<turn role="assistant">&lt;b> &amp; &quot;q&quot; &amp;lt;<image/></turn>\n'
    )
    assert [tuple(a) for a in one["attachments"]] == [
        ("document", "d.pdf", 1, 768),
        ("audio", "s.wav", 1, 38),
        ("image", "i.png", 2, 4),
    ]
    assert one["expanded_tokens"] == 810 and len(one["loss"]) == 1
    s = one["loss"][0]
    assert one["formatted"][s["start"] : s["start"] + s["length"]].endswith("&amp;lt;<image/>")
    assert found[2]["formatted"] == '<turn role="we&quot;ird&lt;"><odd_kind__/></turn>\n<turn role=""></turn>\n'
    assert found[None]["n_turns"] == 1 and found[None]["loss"][0]["length"] == 0


def test_texts_round_trip(spark):
    rng = random.Random(2)
    pieces = ["<turn role=\"user\">", "</turn>\n", "&amp;", "&", "lt;", "<", '"', "\\", "\n", "é😀", " a "]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
            rows.append((c, t, rng.choice(["user", "assistant", 'r"<&']), text if t else None))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(frame.withColumn("parts", chat.whole_parts(chat.text_parts(F.col("text")))))
    read = done.select(
        "id", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss")).alias("t")
    )
    for r in read.collect():
        turns = [(role, text or "") for c, _, role, text in rows if c == r["id"]]
        assert [tuple(x) for x in r["turns"]] == turns
        assert r["t"] == "".join(x for role, x in turns if role == "assistant")
