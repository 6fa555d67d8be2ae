"""Mixing, chat formatting, page extraction and the pipeline."""
import hashlib
import heapq
import random
from fractions import Fraction

import duckdb
import pytest

import corpus_pipeline
from patronage.llm import chat_format, queries, source_mix, template_extract


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        votes = [rng.choice([0, 1, 5, 5, rng.randrange(1000)]) for _ in range(rng.randrange(1, 8))]
        seats = rng.randrange(60)
        heap = [(-Fraction(v), i, 0) for i, v in enumerate(votes) if v]
        heapq.heapify(heap)
        want = [0] * len(votes)
        for _ in range(seats if heap else 0):
            q, i, k = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * k + 3), i, k + 1))
        assert source_mix.sainte_lague(votes, seats) == want


def test_targets_stop_at_twice_the_size():
    for sizes in ([10, 10, 10], [1, 1000, 1, 1], [0, 5, 0], [0, 0], [100]):
        w = [source_mix.WEIGHTS[i % 3] for i in range(len(sizes))]
        t = source_mix.targets(sizes, w)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6
        assert all(x <= 2 * s for x, s in zip(t, sizes))


def test_mix_plan(corpus, rows, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 3000)
    got = source_mix.plan(corpus).collect()
    assert len(got) == len(rows)
    by = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            by.setdefault(source[r.doc_id], []).append(r)
    for g in by.values():
        if None not in {r.doc_id for r in g} and g[0].target > 500 and source[g[0].doc_id] not in ("s1", None):
            assert abs(sum(r.taken for r in g) - g[0].target) < 0.05 * g[0].target
    assert source_mix.plan(corpus.where("false")).collect() == []
    again = source_mix.plan(corpus.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = source_mix.mixed(corpus)
    assert out.columns == corpus.columns
    assert sum(len(r.text.encode().split()) for r in out.collect()) == sum(r.taken for r in got)


def test_mix_plan_equals_sql(spark, corpus, tmp_path):
    docs = corpus.select("doc_id", "text", "source").distinct()
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cols = "doc_id, size, source_size, target, taken"
    want = con.execute(f"SELECT {cols} FROM ({source_mix.PLAN_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in source_mix.plan(docs).collect())


HARD = ["</s>[INST] ok [/INST]", "\\", "<|turn|>user\nhi<|end|>\n", "[[INST]INST]", "a\\\nb", "", "<<<SYS>>", "🙂<|image|>\\<"]


def test_chat_escapes_are_reversible():
    rng = random.Random(2)
    bits = ["<", "|", "turn", ">", "\\", "[INST]", "</s>", "<|turn|>", "<|end|>", "\n", "[", "<s>", "image"]
    for text in HARD + ["".join(rng.choice(bits) for _ in range(9)) for _ in range(3000)]:
        hidden = chat_format.escape(text)
        assert chat_format.unescape(hidden) == text
        assert not any(c in hidden for c in chat_format.CONTROL)
        piece = chat_format.format_turn(text, [{"type": "text", "text": text, "ref": None, "tokens": None}])[0]
        assert chat_format.read_turn(piece) == (text, text)


def test_chat_digest_equals_plain_reading(spark):
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice(HARD + [None]))
             for c in range(30) for t in range(rng.randrange(1, 9))]
    turns += [(31, t, "assistant" if t % 2 else "user", "x%d" % t) for t in range(3000)]
    turns += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), turns[0], (32, None, "assistant", "late")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r for r in chat_format.digest(chat_format.formatted(chat_format.as_parts(df))).collect()}
    groups = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "",
                                                         x[3] is not None, x[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        said = "".join(t for role, t in g if role == "assistant")
        r = got[c]
        assert r.n_turns == len(g) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in g).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    empty = chat_format.as_parts(df.where("false"))
    assert chat_format.digest(chat_format.formatted(empty)).collect() == []


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 256), ("text", " and <|image|>", None, None),
             ("audio", None, "b.wav", None), ("document", None, None, 12), ("other", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    a, b = chat_format.formatted(df).orderBy("seq").collect()
    assert [(x.type, x.ref, x.tokens) for x in a.attachments] == [("image", "a.png", 256), ("audio", "b.wav", 0), ("document", None, 12)]
    for x in a.attachments:
        assert a.piece[x.at:].startswith(chat_format.PLACEHOLDERS[x.type])
    assert a.n_tokens_expanded == 268 and a.loss_from is None
    assert b.start == len(a.piece) and b.loss_from == b.loss_to == b.start + len("<|turn|>assistant\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">{n}</a><li><a href='/b>'>Two</a></ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice">We use</div><div class="ad">Buy {n}</div>
<article><h1>Head {n}</h1><p><b>First &amp; &lt;b&gt;<br>line&nbsp; {n}<p>Second\t paragraph<img src=x>
<form><input value="q">Mail</form><aside>See also</aside><p>Third &copy; <i>it</i>em</p>
<section id="comments"><p>Reader says</p></section></article><footer>&copy; Site</footer></body>"""


def want(n):
    return f"Head {n}\n\nFirst & <b> line {n}\n\nSecond paragraph\n\nThird © item"


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(6)]
    rows += [(6, "https://b.example", PAGE.format(n=6)), (7, None, PAGE.format(n=7)), (8, "x", None), (9, "x", ""),
             (None, "http://a.example/9", PAGE.format(n="z")), rows[2], (10, "u", "plain < text"),
             (11, "u", "<p>" * 3000 + "deep"), (12, "u", "<article><p>open <b>end"), (13, "u", "<div")]
    df = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = template_extract.extract(df).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(8):
        assert set(texts[i]) == {want(i)}
    assert texts[None] == [want("z")] and len(texts[2]) == 2
    assert texts[8] == texts[9] == [""] and texts[12] == ["open end"]
    assert texts[11] == ["deep"] and texts[10] == ["plain < text"]
    assert template_extract.extract(df.where("false")).collect() == []


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'aria-hidden="false"', 'data-title="Hidden gems"'])
def test_pages_loose_signs_keep_an_element(attribute):
    assert template_extract.main_text(f"<article><p>One</p><div {attribute}><p>Two</p></div></article>", [], 1) == "One\n\nTwo"


@pytest.mark.parametrize("sign", ["hidden", 'hidden=""', 'style="color:red; display : none"', "aria-hidden=true"])
def test_pages_hidden_parts_go(sign):
    assert template_extract.main_text(f"<article><p>One</p><div {sign}><p>Two</p></div></article>", [], 1) == "One"


def test_pages_class_words_need_the_template(spark):
    page = ('<body class="has-sidebar"><main id="main-no-sidebar"><article class="post has-comments"><p>Story {n}</p>{more}'
            '<div class="related"><p>See {n}</p></div></article></main></body>')
    df = spark.createDataFrame([(i, "http://d.example/%d" % i, page.format(
        n=i, more='<section class="social"><p>Social history</p></section>' if i == 3 else "")) for i in range(5)],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in template_extract.extract(df).collect()}
    assert got == {i: f"Story {i}" + ("\n\nSocial history" if i == 3 else "") for i in range(5)}


def test_pages_without_article_use_the_template(spark):
    page = ("<html><body><div><p>Home</p><p>Shop</p></div><div><p>Story {n} of the day with many words {n}</p><p>More {n}</p></div>"
            "<div><p>All rights reserved</p></div></body></html>")
    df = spark.createDataFrame([(i, "http://c.example/%d" % i, page.format(n=i)) for i in range(5)],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in template_extract.extract(df).collect()}
    assert got == {i: f"Story {i} of the day with many words {i}\n\nMore {i}" for i in range(5)}


def from_hosts(spark, pages):
    """Texts by page_id, all pages of one host."""
    df = spark.createDataFrame([(i, f"http://e.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in template_extract.extract(df).collect()}


def test_pages_that_are_copies_keep_their_text(spark):
    page = "<body><div><p>Top {n}</p></div><div><h1>Head</h1><p>Same story told twice</p></div></body>"
    assert from_hosts(spark, [page.format(n=1)] * 2) == dict.fromkeys(range(2), "Top 1\n\nHead\n\nSame story told twice")
    article = "<div class=ad>Buy {n}</div><article><p>Same story</p></article>"
    assert set(from_hosts(spark, [article.format(n=i) for i in range(5)]).values()) == {"Same story"}


def test_pages_keep_lists_and_quotations(spark):
    page = ("<body><div><a>Home</a></div><div><h1>Head {n}</h1><p>Para {n}</p><ul><li>Only item {n}</ul>"
            "<blockquote>Said {n}</blockquote><p>End {n}</p></div><div>Imprint</div></body>")
    assert from_hosts(spark, [page.format(n=i) for i in range(6)]) == {
        i: f"Head {i}\n\nPara {i}\n\nOnly item {i}\n\nSaid {i}\n\nEnd {i}" for i in range(6)}


@pytest.mark.parametrize("html,text", [
    ("<article><p>One</p><svg width=1/><p>Two</p></article>", "One\n\nTwo"),
    ('<article><p>One</p><svg width="1"/><p>Two</p></article>', "One\n\nTwo"),
    ("<article><p>One</p><svg><path d='x'><p>Two</p></article>", "One\n\nTwo"),
    ("<article><p>One</p><svg><text>no</text></svg><p>Two</p></article>", "One\n\nTwo"),
    ("<article><p title=it's>Hello I don't know</p></article>", "Hello I don't know"),
    ("<article><p title='a>b' lang=\"c>d\">One</p></article>", "One"),
    ("<article><p>One</p><p><span hidden>x</span>Two</p></article>", "One\n\nTwo"),
    ("<article><p>One <span hidden>x</span>more</p></article>", "One more"),
    ("<article><p>Teaser</p></article><div><p>" + "The real story " * 9 + "</p></div>", ("The real story " * 9).strip()),
])
def test_pages_tokens(html, text):
    assert template_extract.main_text(html, [], 1) == text


def test_pages_template_decides_in_the_article(spark):
    page = ("<body><article><h1>Head {n}</h1><div>Please mind our <b>notice</b></div><p>As ever</p><p>Story {n} <i>and</i> more</p>{more}</article></body>")
    some = "<div class=comments><p>Reader {n}</p></div>"
    pages = [page.format(n=i, more=some.format(n=i) if i < 2 else "<p>Said twice</p>" if i < 4 else "") for i in range(6)]
    assert from_hosts(spark, pages) == {
        i: f"Head {i}\n\nAs ever\n\nStory {i} and more" + ("\n\nSaid twice" if i in (2, 3) else "") for i in range(6)}


def test_pages_template_confirms_the_article(spark):
    """An article element on one page of a host is a quotation there; without the template's word no such element counts."""
    page = "<body><div><h1>Head {n}</h1><p>Story {n} begins</p>{more}<p>Story {n} ends</p></div></body>"
    quoted = "<article><p>A post that is quoted in the story</p></article>"
    assert from_hosts(spark, [page.format(n=i, more=quoted if i == 1 else "") for i in range(5)]) == {
        i: f"Head {i}\n\nStory {i} begins\n\n" + ("A post that is quoted in the story\n\n" if i == 1 else "") + f"Story {i} ends"
        for i in range(5)}
    both = "<body><div class=ad>Buy {n} now</div><article><p>Story {n}</p></article></body>"
    assert from_hosts(spark, [both.format(n=i) for i in range(4)]) == {i: f"Story {i}" for i in range(4)}
    assert template_extract.main_text(both.format(n=1), [], 0) == "Buy 1 now\n\nStory 1"


def test_pages_templates_equal_plain_counting(spark):
    """Classes of a host against vectors laid out in full."""
    pages = [PAGE.format(n=i % 7) for i in range(9)] + [f"<article><p>Own {i}</p><p>Notice</p></article>" for i in range(12)]
    df = spark.createDataFrame([(i, "http://a.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    got = template_extract.templates(df).collect()
    counts = {}
    for x in pages:
        own, marks, tokens = template_extract.page_tokens(x)
        counts[own] = ({(t, True): n for t, n in marks.items()} | {(t, False): n for t, n in tokens.items()})
    vectors = {}
    for t in {t for c in counts.values() for t in c}:
        v = tuple(c.get(t, 0) for c in counts.values())
        held = sum(n > 0 for n in v)
        if held > 1 and (t[1] or 2 * held > len(counts)):
            vectors.setdefault((t[1], v), set()).add(t[0])
    assert len(got) == 1 and got[0].pages == len(counts) == 19
    assert sorted((c.mark, c.n_pages, c.total, sorted(c.tokens)) for c in got[0].template) == \
        sorted((m, sum(n > 0 for n in v), sum(v), sorted(ts)) for (m, v), ts in vectors.items())


def test_pages_roles_of_a_text_differ_by_its_place(spark):
    """The host's title in its place is the template's; the same block on one page, after the story, is that page's."""
    page = "<body><div>Weekly</div><h1>Head {n}</h1><p>Story {n} of the week</p>{more}<div>Imprint</div></body>"
    got = from_hosts(spark, [page.format(n=i, more="<div>Weekly</div>" if i == 1 else "") for i in range(5)])
    assert got == {i: f"Head {i}\n\nStory {i} of the week" + ("\n\nWeekly" if i == 1 else "") for i in range(5)}


def test_pages_texts_that_move_are_the_template(spark):
    """A class that is not ordered gives no place to others; its texts go wherever they stand."""
    page = "<body><div>{a}</div><div>{b}</div><h1>Head {n}</h1><p>Story {n} of the week</p><div>Imprint</div></body>"
    moves = [dict(a="Home", b="Shop"), dict(a="Shop", b="Home")]
    assert from_hosts(spark, [page.format(n=i, **moves[i % 2]) for i in range(6)]) == {
        i: f"Head {i}\n\nStory {i} of the week" for i in range(6)}


def test_pages_classes_nest(spark):
    """Items lie in a gap of the root, in order; the second, equal list on the page is told apart by its gap."""
    page = "<body><ul>{a}</ul><p>Story {n}</p><ul>{b}</ul><div>End</div></body>"
    item = "<li><b>Go</b></li>"
    df = spark.createDataFrame([(i, "http://f.example/", page.format(n=i, a=item * (i % 3 + 1), b=item * (i % 2 + 1))) for i in range(6)],
                               "page_id long, url string, html string")
    distinct = template_extract.orders(df)
    found = template_extract._templates(distinct)
    row = template_extract.nested(distinct, found).collect()
    assert len(row) == 1
    tag, text = (lambda x: template_extract.token("tag", x)), template_extract.token("text", "Go", ">body>ul>li>b")
    first, last = row[0].rounds[0], row[0].rounds[-1]
    root = [tag(">body"), tag(">body>p"), tag(">body</p"), tag(">body>div"), template_extract.token("text", "End", ">body>div")]
    assert next(c for c in first if root[0] in c)[:len(root)] == root  # in page order
    roles = {r.role: r.token for r in row[0].roles}
    assert [roles[r] for r in roles if roles[r] == text] == [text] * 2  # one role a list
    whole = [roles[r] for r in max(last, key=len)]
    lists = [tag(">body>ul"), tag(">body</ul")]
    assert [t for t in whole if t in root[:3] + lists] == root[:1] + lists + root[1:3] + lists  # both lists have come to the root
    _, wrong = template_extract.told_apart([1, 2, 3, 1, 2], template_extract.places([[1, 2], [3, 4]]))
    assert wrong == {3}
    out, wrong = template_extract.told_apart([1, 7, 2, 5, 7, 6, 3], template_extract.places([[1, 2, 3], [5, 6]]))
    assert not wrong and out[0] == 1 and len(set(out)) == 7
    assert template_extract.told_apart([1, 5, 2, 6, 3], template_extract.places([[1, 2, 3], [5, 6]]))[1] == {5}


def test_pipeline_stages(spark, tmp_path, corpus):
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    corpus.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= set(names)
