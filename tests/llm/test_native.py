"""The operators made of Spark expressions alone: URL rules and chat formatting."""

from retrievo.llm.chat import format_chats, read_chats
from retrievo.llm.url_rules import judge

RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("org", "", "block"), ("a.b.org", "/x", "allow"),
         ("tie.org", "/", "allow"), ("tie.org", "/", "block"), (None, "/", "block"), ("tie.org", "/", "allow")]


def _verdict(url):
    head, found, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut]) if found else ""
    path = rest[cut:] if found else ""
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [((len(h + p), a == "block", h), h.lower() + p, a) for h, p, a in RULES if h is not None
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(None, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = ["http://a.net/", "http://a.net", "https://M.EXAMPLE.net/en/1?x=/", "https://example.net/en", "ftp://net/q#/",
            "x.org/y", None, "", "://a.b.org/x/y", "http://c.a.b.org/xx", "http://b.org/?://", "http://tie.org/",
            "http://..net/", "http://notnet/", "http://a\nb.net/\n/", "http://Äb.NET/é", "h://" + "l." * 500 + "net/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls + urls[:3])],
                                  "page_id long, url string, prefix string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    out = judge(pages, rules)
    assert out.columns == ["page_id", "url", "prefix", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == _verdict(r.url), r.url
    assert {r.verdict for r in judge(pages, rules.where("false"), default="block").collect()} == {"block"}
    assert judge(pages.where("false"), rules).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_chats(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "plain\ntext", "\\o\\b[<\\", "<s>", "x" * 100_000, "ü🎉"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t, "k") for i, t in enumerate(texts)]
    rows += [(2, 0, "sys\n[tem]\\n", "a", "k"), (2, None, None, "first", None), (2, 0, "assistant", "b", "k"),
             (2, 0, "assistant", "b", "k"), (None, 1, "user", "no id", "k")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = read_chats(format_chats(frame))
    got = {r.conv_id: r for r in made.collect()}
    for conv in (1, 2, None):
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, _, r, x in want]
        assert got[conv].loss_text == "".join(x for _, _, r, x in want if r == "assistant")
        for s in got[conv].loss_mask:
            assert not {"[", "<"} & set(got[conv].formatted[s.start:s.start + s.length])
    assert got[2].formatted.count("[INST]") == 3  # the assistant's two turns are one
    assert format_chats(frame.where("false")).count() == 0
    assert "Python" not in made._jdf.queryExecution().toString()
