"""Each operator does the whole job: cases that an earlier cut lost."""

import json
import math
import random
import struct
import time
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from citeline.llm import bpe, chat, html_extract, media, quality, simhash


@pytest.mark.parametrize("start", ["<body>", "", "<body class=x><div>", "<main>"])
def test_html_head_without_an_end_tag(start):
    nodes, blocks = html_extract.parse(f"<html><head><title>t</title><meta charset=utf-8><style>p {{}}</style>{start}<p>Some text.</p><p>More.</p>")
    assert [text for _, text in blocks] == ["Some text.", "More."]


def test_html_text_ends_an_open_head():
    assert [t for _, t in html_extract.parse("<head><title>t</title> Bare text <b>here</b>")[1]] == ["Bare text here"]
    assert html_extract.parse("<head><title>t</title><script>x</script> </head>")[1] == []
    model = html_extract.Model(html_extract.labelled_pages())
    body = "<article><h1>A title</h1><p>A sentence that is long enough to be read as content of the page.</p></article>"
    assert model.extract(f"<html><head><title>t</title><body>{body}") == model.extract(f"<html><head><title>t</title></head><body>{body}") != ""


def test_simhash_keeps_unrelated_rows_that_share_a_key(spark):
    words = "red green blue cyan pink grey teal gold lime navy rust sand plum mint jade ruby".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i + 1)) % 16] + str(i) for j in range(30))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, text(5))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted({(k or 0, t) for k, t in rows})


def test_quality_model_is_of_real_characters(spark):
    """Against a plain Kneser-Ney over code points; each text by the model of all."""
    texts = ["the cat sat on the mat. " * 3, "мама мыла раму", "THE 12 dogs", "你好世界", "", "the cat\0sat"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, tag long")
    asked = [*texts, "unseen Ωord", "рама мыла маму"]
    rows = quality.scored(spark.createDataFrame([(t, t) for t in asked], "text string, asked string"), quality.trained(df)).collect()
    n = quality.LENGTH

    def grams(t):
        p = quality.START * (n - 1) + t.replace("\0", "\ufffd") + quality.STOP
        return [p[i : i + n] for i in range(len(t) + 1)]

    orders = {n: Counter(g for t in texts for g in grams(t))}
    for k in range(n - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    cuts = {k: quality.discounts_of(*(Counter(c.values())[i] for i in (1, 2, 3, 4))) for k, c in orders.items()}

    def prob(g):
        k = len(g)
        if not k:
            return 1 / (len(orders[1]) + 1)
        same = {x: c for x, c in orders[k].items() if x[:-1] == g[:-1]}
        low, total = prob(g[1:]), sum(same.values())
        cut = lambda c: cuts[k][min(c, 3) - 1]
        return ((same[g] - cut(same[g]) if g in same else 0) + sum(map(cut, same.values())) * low) / total if same else low

    found = {r.asked: (r["__symbols"], r["__nats"]) for r in rows}
    for t in asked:
        assert found[t][0] == len(t) + 1 and math.isclose(found[t][1], -sum(math.log(prob(g)) for g in grams(t)), rel_tol=1e-9)


def test_quality_tells_texts_of_one_script_apart(spark):
    r = random.Random(5)
    words = "река камень дом вода лес ветер снег поле трава дорога".split()
    clean = [(i, " ".join(r.choice(words) for _ in range(40)), "ru") for i in range(200)]
    letters = sorted(set("".join(words)))
    junk = [(500 + i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40)), "ru") for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    found = {x.doc_id: x.accepted for x in quality.classify(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(found[i] for i, *_ in junk) and sum(not found[i] for i, *_ in clean) <= 4


def test_quality_trusts_no_toxic_text(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in quality.trusted_ids(labels).collect()) == [1, 3]


def test_chat_survives_bad_json(spark):
    call = lambda i, **more: json.dumps({"tool_calls": [{"id": i, "name": "answer", "arguments": {"prompt": "p", "turn": 1}} | more]})
    texts = [
        call("a", arguments='{"prompt": "p", "turn": NaN}'), call("b", arguments='{"prompt": "p", "turn": 1e400}'), call("c", arguments='{"prompt": "\\ud800", "turn": 1}'),
        call("d", after=5), '{"tool_calls": [{"id": "e", "arguments": ' + "[" * 100_000 + "]" * 100_000 + "}]}", call("f", arguments="[" * 600 + "]" * 600), call("g", id=[1, {"x": None}]), call("h", after=[None, "d", 7]),
        '{"tool_calls": [{"id": "i", "name": "answer", "arguments": {"prompt": "\\udc00", "turn": 2.0}}]}',
    ]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    found = {r.turn: r for r in chat.linked(*chat.exchanges(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(found) == len(texts)
    assert not found[0].valid and not found[1].valid and found[2].valid and "\ufffd" in found[2].json
    assert found[3].valid and found[3].level == 0 and found[4].kind == "result" and not found[5].valid
    assert found[6].call_id == '[1, {"x": null}]' and found[7].level == 2 and found[8].valid and "\ufffd" in found[8].json


def test_chat_conversations_named_by_text(spark):
    rows = [("a-1", 0, "user", "ask"), ("a-1", 1, "assistant", "say"), (None, 0, "user", "x")]
    found = chat.linked(*chat.exchanges(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or "", r.state) for r in found) == [("", "repeated"), ("a-1", "linked"), ("a-1", "linked")]
    assert {json.loads(r.json)["conversation"] for r in found} == {"a-1", None}


def test_chat_orders_long_chains_and_joins(spark):
    """A chain of 600 calls, a call that joins two of it, a cycle and what hangs on it."""
    rows = [(1, i, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(600)] + [(1, 700, "j", ["c10", "c500"]), (1, 701, "k", ["j"]), (1, 702, "m", ["k", "c2"])]
    rows += [(2, 0, "x", ["y"]), (2, 1, "y", ["x"]), (2, 2, "z", ["x"]), (2, 3, "w", ["z", "v"]), (2, 4, "v", ["nothing"])]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>")
    found = {r.call_id: r.level for r in chat.levels(calls).collect()}
    assert len(found) == len(rows) and all(found[f"c{i}"] == i for i in range(600))
    assert (found["j"], found["k"], found["m"]) == (501, 502, 503)
    assert [found[k] for k in "xyzwv"] == [None, None, None, None, 0]


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<p>Start.<svg/> after", ["Start. after"]), ("<p>a<svg><path d=x/><g>no</g></svg> b", ["a b"]), ("<p>x <math/>y<p>z", ["x y", "z"]),
        ("<button>Menu <p>One.</p><p>Two.</p>", ["Menu", "One.", "Two."]), ("<button>no</button><p>One.", ["One."]), ("<button>Go <p>One.</p><button>no</button>", ["Go", "One."]),
        ("<select><option>a<p>One.</p>", ["a", "One."]), ("<object><p>no</p></object><p>yes", ["yes"]), ("<title>t <p>One.</p>", ["t", "One."]), ("<noscript><p>One.", ["One."]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]), ("<p>a <!-- never closed <p>b", ["a"]), ("<p>1 < 2 &amp; 3", ["1 < 2 & 3"]),
        ("<p>a</b></div></p>b<dl><dt>t<dd>u<dt>v</dl>", ["a", "b", "t", "u", "v"]),
    ],
)
def test_html_lenient_parsing(page, wanted):
    assert [text for _, text in html_extract.parse(page)[1]] == wanted


@pytest.mark.parametrize("page", ["<a " * 400_000, "<i>" * 150_000 + "</b>" * 150_000, "<b>y " * 200_000, "<div>" * 150_000, "<p><table>" + "<div>" * 150_000, "<title>" * 100_000 + "x", "<button>" * 100_000, "<svg>" * 100_000 + "</svg>", "<!" * 400_000, "<a \"" * 200_000 + ">"])
def test_html_parsing_is_linear(page):
    started = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - started < 6


def test_media_of_malformed_containers(spark):
    good = media.build(bytes(range(64)) * 3)
    trak = lambda *inner: media.box(b"moov", media.box(b"trak", media.box(b"mdia", *inner)))
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    bad = [trak(media.box(b"mdhd")), trak(media.box(b"stz2")), trak(media.full(b"stsz", struct.pack(">II", 1, 2**32 - 1))), deep, trak(media.full(b"co64", struct.pack(">IQ", 1, 2**64 - 1)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), media.full(b"stsz", struct.pack(">III", 0, 1, 5)))]
    bad += [good[:n] for n in range(1, len(good), 37)] + [b"", b"\0" * 20, b"\0\0\0\1moov" + b"\xff" * 8]
    r = random.Random(3)
    for _ in range(300):
        x = bytearray(good)
        for _ in range(3):
            x[r.randrange(len(x) - 200)] = r.randrange(256)
        bad.append(bytes(x))
    df = spark.createDataFrame([(bytearray(good), "mine")] + [(bytearray(x), "mine") for x in bad], "content binary, tracks string")
    found = media.media_columns(df).collect()
    assert len(found) == len(bad) + 1 and all(x.tracks == "mine" for x in found)
    assert found[0].media_error is None and found[0]["tracks_"][0].samples == 3
    assert all(x.media_error for x in found[1:6]) and all((x.media_error is None) != (x["tracks_"] is None) for x in found)


def test_media_of_fragments():
    """Two fragments of one track: sizes of their own and by default, a first sample that is a keyframe."""
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    tkhd = media.full(b"tkhd", u(0, 0, 7, 0, 0), bytes(60), flags=3)
    mdia = media.box(b"mdia", media.full(b"mdhd", u(0, 0, 1000, 0), bytes(4)), media.full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), media.box(b"minf", media.box(b"stbl", media.full(b"stsd", u(1), media.box(b"avc1", bytes(78))))))
    moov = media.box(b"moov", media.box(b"trak", tkhd, mdia), media.box(b"mvex", media.full(b"trex", u(7, 1, 40, 9, 0x10000))))

    def moof(trun, flags, n, *more):
        make = lambda offset: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u(7), flags=0x20000), media.full(b"trun", u(n), struct.pack(">i", offset), *more, flags=flags)))
        return make(len(make(0)) + 8)

    one = moof(None, 0x1 | 0x4 | 0x200, 3, u(0), u(5, 6, 7)) + media.box(b"mdat", b"a" * 18)
    two = moof(None, 0x1, 2) + media.box(b"mdat", b"b" * 18)
    content = media.box(b"ftyp", b"iso5", u(0)) + moov + one + two
    (track,) = media.tracks(content)
    assert (track["codec"], track["samples"], track["media_bytes"], track["duration"]) == ("avc1", 5, 36, 200)
    assert media.stored_bytes(content, track) == b"a" * 18 + b"b" * 18
    assert track["keyframes"] == [{"offset": content.index(b"aaa"), "size": 5}]


def test_pieces_follow_the_counted_cost():
    counts = [simhash.pieces_for(n, 4) for n in (10, 10**5, 10**7, 10**9, 10**11)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] >= 2
    assert simhash.cost_of(4, 5)[0] == 5 < simhash.cost_of(4, 3)[0] < simhash.cost_of(4, 2)[0]


def test_portions_of_long_texts_encode_as_the_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Transducer(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(8)
    words = ["don't", "it's", "naïve", "2024", "...", "a\n\nb", "  ", "\t x", "😀", "word", "<|endoftext|>", " ", "re-use", "I'll"]
    for text in (" ".join(r.choice(words) for _ in range(60_000)), "x" * 200_000, "  ".join(r.choice(words) for _ in range(30_000)), "\n".join(r.choice(words) for _ in range(40_000)) + " end here"):
        parts = list(own.portions(text))
        assert [i for p in parts for i in p] == library.encode(text, add_special_tokens=False).ids
        assert "".join(own.decoded(parts)) == text
    assert len(list(own.portions("one two " * 40_000))) > 3


PROSE = ["The markets have been calm for the whole of this long week. " * 4, "Nobody expects that the rates will be lowered any time soon. " * 4]
NOTICE = '<div class="cookie-notice"><p>We use cookies to improve this site. By going on you accept them.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        '<body><article class="cookie-recipe"><h1>Best of the week</h1><p>{}</p><p>{}</p></article></body>', '<body><div class="commentary"><h1>Best of the week</h1><p>{}</p><p>{}</p></div></body>',
        '<body><div class="cookie-recipe"><h1>Best of the week</h1><p>{}</p><p>{}</p></div>' + NOTICE + "</body>", '<body><div id="menu-of-the-day" class="bannerman"><h1>Best of the week</h1><p>{}</p><p>{}</p></div></body>',
        '<body><main class="search-results"><h1>Best of the week</h1><p>{}</p><p>{}</p></main></body>',
    ],
)
def test_html_prose_outweighs_class_words(page):
    model = html_extract.Model(html_extract.labelled_pages())
    assert model.extract(page.format(*PROSE)) == "\n".join(["Best of the week", *(p.strip() for p in PROSE)])


def test_html_comments_stay_out_however_long():
    model = html_extract.Model(html_extract.labelled_pages())
    page = f'<body><article><h1>Best of the week</h1><p>{PROSE[0]}</p></article><section class="comments"><article class="comment"><p>{PROSE[1]}</p></article></section></body>'
    assert model.extract(page) == "\n".join(["Best of the week", PROSE[0].strip()])


def test_quality_decisions_by_a_plain_model(spark):
    """Perplexity, threshold and decision of every row of ``classify`` against a plain computation with held-out halves."""
    r = random.Random(11)
    words = "alpha beta gamma delta river stone under over the of and".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(2, 30))), r.choice(["en", "de", None])) for i in range(80)] + [(90, "zzqx kkwv jjqz " * 6, "en"), (91, None, "de"), (92, "", None), (3, "the of and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60)], "doc_id long, quality int")
    half = {x.text: x.h for x in df.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    n = quality.LENGTH

    def grams(t):
        p = quality.START * (n - 1) + (t or "") + quality.STOP
        return [p[i : i + n] for i in range(len(t or "") + 1)]

    def model(texts):
        orders = {n: Counter(g for t in texts for g in grams(t))}
        for k in range(n - 1, 0, -1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])
        cuts = {k: quality.discounts_of(*(Counter(c.values())[i] for i in (1, 2, 3, 4))) for k, c in orders.items()}
        after = {}
        for k, c in orders.items():
            for g, m in c.items():
                after.setdefault(g[:-1], {})[g] = (m, cuts[k][min(m, 3) - 1])

        def prob(g):
            if not g:
                return 1 / (len(orders[1]) + 1)
            low, same = prob(g[1:]), after.get(g[:-1])
            if not same or len(next(iter(same))) != len(g):
                return low
            total = sum(m for m, _ in same.values())
            m, d = same.get(g, (0, 0))
            return (m - d + sum(d for _, d in same.values()) * low) / total

        return lambda t: -sum(math.log(prob(g)) for g in grams(t))

    trusted = [(t, lang) for i, t, lang in rows if i < 60]
    models = {0: model([t for t, _ in trusted if half[t] == 1]), 1: model([t for t, _ in trusted if half[t] == 0]), 2: model([t for t, _ in trusted])}
    nats = lambda i, t: models[half[t] if i < 60 else 2](t)
    size = lambda t: len(t or "") + 1
    held = [(lang, nats(0, t), size(t)) for t, lang in trusted]
    whole = sum(a for _, a, _ in held) / sum(b for *_, b in held)
    mean = {x: sum(a for lang, a, _ in held if lang == x) / sum(b for lang, _, b in held if lang == x) for x in ("en", "de")}
    level = lambda lang, a, b: (a + 60.0 * mean.get(lang, whole)) / (b + 60.0)
    top = lambda v: sorted(v)[math.ceil(0.99 * len(v)) - 1] + math.log1p(0.15)
    limit = {x: top([level(*h) for h in held if h[0] == x]) for x in ("en", "de")} | {None: top([level(*h) for h in held])}
    found = Counter((x.doc_id, x.lang, round(x.perplexity, 6), round(x.threshold, 6), x.accepted) for x in quality.classify(df, labels).collect())
    wanted = Counter((i, lang, round(math.exp(nats(i, t) / size(t)), 6), round(math.exp(limit[lang]), 6), level(lang, nats(i, t), size(t)) <= limit[lang]) for i, t, lang in rows)
    assert found == wanted and not all(x[-1] for x in found)


def test_neighbouring_tokens_are_judged_at_their_seam(monkeypatch):
    """Pairs are judged as by merging their bytes, and words of known tokens need no such merging."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, r = bpe.Transducer(path), random.Random(8)
    tokens = [i for i in sorted(t.id_of.values()) if t.proper(i)]
    short = [i for i in tokens if len(t.bytes_of[i]) < 4]
    pairs = [(r.choice(x), r.choice(y)) for x in (tokens, short) for y in (tokens, short) for _ in range(3000)] + [(i, i) for i in tokens[::20]]
    pairs += [t.parts[i] for i in r.sample(sorted(t.parts), 1000)]
    fits = [t.compatible(*p) for p in pairs]
    assert fits == [t.merged(t.bytes_of[a] + t.bytes_of[b]) == [t.bytes_of[a], t.bytes_of[b]] for a, b in pairs] and {*fits} == {True, False}
    merges = []
    monkeypatch.setattr(t, "merged", lambda data: merges.append(data))
    words = [" " + "".join(r.choice("etaoinshrdlu") for _ in range(9)) for _ in range(300)]
    found = [t.encode(w) for w in words]
    assert not merges and found == [Tokenizer.from_file(path).encode(w, add_special_tokens=False).ids for w in words[:20]] + found[20:]
