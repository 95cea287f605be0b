from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binsift.llm import decontaminate, fingerprint, html, pieces
from binsift.llm._text import WORD_RE, prefix_hash, span_hash, word_hashes
from binsift.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a> Site name and motto of the whole site</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make the site better for you and for all of the others.</div><aside class=sidebar><p>Read also the other story about the thing that is in the news.</p></aside>
<article><header><h1>The headline &amp; more</h1></header><p>First   paragraph of the story, which is long enough to be called
a block of text in the article of the page.<p>Short one.</p><div class="ad">Buy this thing now, it is the best of all the things that are sold.</div>
<p>See <a href=/x>the other page about this with a very long link text inside of it all</a></p><p>Last paragraph with <b>bold</b> &eacute;&#233; and a <i>slanted</i> word, and it is again as long as the others are.</p>
<section class="comments"><p>I think that the article is wrong and that it should not be here at all, said a reader.</p></section><form><p>Write a comment of your own in the box that is below this text, please.</p></form></article>
<footer>&copy; the site</footer></body></html>"""


def test_main_text():
    text, _, _ = html.main_text(PAGE)
    assert text.split("\n") == [
        "The headline & more",
        "First paragraph of the story, which is long enough to be called a block of text in the article of the page.",
        "Short one.",
        "See the other page about this with a very long link text inside of it all",
        "Last paragraph with bold éé and a slanted word, and it is again as long as the others are.",
    ]


def test_pages_without_article_elements():
    para = "<p>" + "This is the text of the page and it has a lot of the small words that are in all texts of the kind, so it is good. " * 2
    page = f"<div><a href=/>a</a> <a href=/b>b</a></div><div>{para}</p><p>Tiny.</p>{para}</p></div><div><a href=/c>Copyright Acme Corp International Ltd Holdings</a></div>"
    got = html.main_text(page)[0].split("\n")
    assert len(got) == 3 and got[1] == "Tiny."


def test_wrappers_of_the_article_are_no_furniture():
    para = "<p>This is the text of the page and it has a lot of the small words that are in all texts of the kind.</p>"
    page = f"<div class='page has-sidebar'><main>{para}</main></div><div id=comments><article class=comment>{para}</article></div>"
    assert html.main_text(page)[2] == 1
    assert html.main_text(f"<aside><article>{para}</article></aside>")[2] == 0


@pytest.mark.parametrize("attrs", ["style='overflow:hidden'", "class=overflow-hidden", 'style="backface-visibility:hidden"', 'aria-hidden="false"', "title='hidden gems'", "data-hidden=1"])
def test_attributes_that_do_not_hide(attrs):
    assert html.main_text(f"<article {attrs}><p>Text of it.</p></article>")[0] == "Text of it."
    assert html.main_text(f"<article><div {attrs}><p>Text of it.</p></div></article>")[0] == "Text of it."


@pytest.mark.parametrize("attrs", ["hidden", "class=x hidden", 'hidden=""', "HIDDEN='until-found'", "aria-hidden=true", "aria-hidden = 'true'", 'style="color:red; display : none"', "style='visibility:hidden!important'", "style=display:none"])
def test_attributes_that_hide(attrs):
    assert html.main_text(f"<article><p>Text of it.</p><div {attrs}><p>Not shown.</p></div></article>")[0] == "Text of it."


@pytest.mark.parametrize(
    "text",
    [
        "Järjestelmä tallentaa kaikki muutokset automaattisesti, joten käyttäjän ei tarvitse huolehtia tiedostojen häviämisestä missään vaiheessa.",
        "Система сохраняет все изменения сама, поэтому пользователю не нужно следить за тем, чтобы файлы не пропали при сбое питания.",
        "系统会自动保存所有更改,因此用户无需担心文件在断电时丢失。" * 4,
    ],
)
def test_pages_of_other_languages_without_article_elements(text):
    links = "".join(f"<a href=/{k}>{text[:30]}</a> " for k in range(5))
    page = f"<div>{links}</div><div><p>{text}</p><p>{text[:20]}</p><p>{text}</p></div><footer>{text}</footer>"
    assert html.main_text(page)[0].split("\n") == [text, text[:20].strip(), text]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>x", "a < b & c", "<p>" * 3000, "<div class='ad'>x</div>", "&nbsp;", "<p title='>'>x</p>", "</p></div>x"])
def test_odd_markup_does_not_break(page):
    html.main_text(page)


def test_extraction_of_defined_cases(spark):
    rows = [(0, "u", None), (1, None, ""), (None, "u", PAGE), (2, "u", PAGE), (2, "u", PAGE), (3, "u", "<article><p>" + "long word of the text " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 6 and [r.text for r in got[:2]] == ["", ""] and all(r.n_chars == len(r.text) for r in got)
    assert got[3].text == got[4].text and got[5].n_chars > 1_000_000
    assert html.extract(df.limit(0)).count() == 0


# -- fingerprints


def levenshtein_kept(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_kept_characters_against_the_table(a, b):
    assert fingerprint.kept(a, b) == levenshtein_kept(a, b)


def test_boundaries_depend_on_context_only():
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefgh ") for _ in range(4000))
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint("inserted words " + text)
    assert a != b and fingerprint.likeness(a, b) > 0.9
    assert fingerprint.likeness(a, fingerprint.fingerprint("".join(draw.choice("ijkl ") for _ in range(4000)))) == 0
    assert fingerprint.likeness(a, fingerprint.fingerprint(text[:2600] + "zz" * 700)) > 0.4


def test_long_texts_are_hashed_in_slices_alike(monkeypatch):
    raw = bytes(random.Random(2).choice(b"abcdef ") for _ in range(5000))
    whole = fingerprint.rolled(raw)
    monkeypatch.setattr(fingerprint, "CHUNK", 700)
    assert all((x == y).all() for x, y in zip(whole, fingerprint.rolled(raw)))


def test_chain_against_the_plain_order(docs):
    draw = random.Random(3)
    rows = [(i * 7, "".join(draw.choice("abc é") for _ in range(draw.randint(0, 300)))) for i in range(37)] + [(1000, None)]
    got = {r.doc_id: r for r in fingerprint.chained(docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        t, nxt = t or "", nxt or ""
        changed = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == fingerprint.fingerprint(t) and got[i].edited_fingerprint == fingerprint.fingerprint(changed)
        assert got[i].near_next == fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(nxt))


def plain_fingerprint(text):
    """The definition, byte by byte: chunks end where the hash of the last 7 bytes falls on size - 1."""
    raw = text.encode()
    padded = bytes(fingerprint.WINDOW - 1) + raw
    hashed = []
    for k in range(len(raw)):
        window = np.frombuffer(padded[k : k + fingerprint.WINDOW], np.uint8)
        hashed.append(int(span_hash(prefix_hash(window), np.array([0]), np.array([fingerprint.WINDOW]))[0]))

    def sign(size):
        out, sum_, begun = "", 0, False
        for h in hashed:
            sum_, begun = sum_ + h % 64, True
            if (h >> 32) % size == size - 1:
                out, sum_, begun = out + fingerprint.ALPHABET[sum_ % 64], 0, False
        return out + fingerprint.ALPHABET[sum_ % 64] if begun else out

    size = 3
    while size * 64 < len(raw):
        size *= 2
    while size > 3 and len(sign(size)) < 32:
        size //= 2
    return f"{size}:{sign(size)}:{sign(2 * size)}"


def test_fingerprints_against_the_definition():
    draw = random.Random(11)
    for n in (0, 1, 6, 7, 40, 200, 900, 3000):
        text = "".join(draw.choice("abcdé fgh") for _ in range(n))
        assert fingerprint.fingerprint(text) == plain_fingerprint(text)
    assert fingerprint.fingerprint("a" * 2000) == plain_fingerprint("a" * 2000)


def test_chain_of_rows_that_repeat_one_id(docs):
    draw = random.Random(12)
    rows = [(draw.choice([1, 2, None]), "".join(draw.choice("ab é") for _ in range(draw.randint(0, 60)))) for _ in range(90)] + [(2, "the same text")] * 30
    got = fingerprint.chained(docs(rows).repartition(7)).collect()
    assert len(got) == 120
    # A chain: every row's edited text ends as some row of the same or the next lower id begins.
    prints = {fingerprint.fingerprint(t) for _, t in rows}
    assert {r.fingerprint for r in got} == prints
    same = [r for r in got if r.doc_id == 2 and r.n_chars == 13 and r.near_next == 1.0]
    assert len(same) >= 29


def test_chain_of_defined_cases(docs, clashing):
    assert fingerprint.chained(docs([])).count() == 0
    one = fingerprint.chained(docs([(5, "abcdef")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "same"), (1, "same"), (None, "x"), (2, ""), (3, "word " * 50_000)]
    got = fingerprint.chained(clashing(rows)).collect()
    assert len(got) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


# -- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def brute_best(v, text):
    """Best summed score of a segmentation, by dynamic programming over all pieces at all positions."""
    table = {t: s for t, _, s in v.pieces}
    single, unknown, longest = {t for t in table if len(t) == 1}, min(table.values()) - 10, max(map(len, table))
    text = " " + text
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - longest), i):
            if (s := table.get(text[j:i])) is not None:
                best[i] = max(best[i], best[j] + s)
        if text[i - 1] not in single:
            best[i] = max(best[i], best[i - 1] + unknown)
    return best[-1], unknown


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aehtn é\n▁  ñ漢\t.!"), min_size=1, max_size=30))
def test_segmentation_is_the_best_one(text):
    v = pieces.Vocabulary.load()
    ids = pieces.Encoder(v).encode(text).tolist()
    score, of = 0.0, {i: s for _, i, s in v.pieces}
    best, unknown = brute_best(v, text)
    covered = " " + text
    n_unknown = sum(c not in {t for t, _, _ in v.pieces if len(t) == 1} for c in covered)
    score = sum(of[i] for i in ids if i in of) + unknown * n_unknown
    assert score == best
    assert pieces.decode_ids(ids, v.surface) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_of_any_text(text):
    v = pieces.Vocabulary.load()
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.decode_ids(pieces.Encoder(v).encode(text).tolist(), v.surface) == text


def test_agrees_with_the_library_on_the_same_scores(vocabulary):
    """The library's own Viterbi, told to read the vocabulary as a unigram one."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    theirs = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    of = {i: s for _, i, s in vocabulary.pieces}
    e = pieces.Encoder(vocabulary)
    draw = random.Random(4)
    for _ in range(60):
        text = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(12))
        assert sum(of[i] for i in e.encode(text).tolist()) >= sum(of[i] for i in theirs.encode(text))


def test_pieces_of_defined_cases(docs, clashing):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "word " * 60_000), (4, "two\nlines ▁"), (4, "two\nlines ▁")]
    got = pieces.round_trip(clashing(rows)).collect()
    assert len(got) == 6 and all(r.exact and r.n_ids == len(r.ids) for r in got)
    assert {r.doc_id for r in got if r.n_ids == 0} == {1, 2}
    assert pieces.round_trip(docs([])).count() == 0


def test_every_document_comes_back_whole(spark, small):
    got = QUERIES["op9_sentencepiece"](spark, small)
    assert got.filter("exact").count() == got.count() == 200


# -- decontamination


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def test_alignment_against_the_table():
    draw = random.Random(5)
    for _ in range(40):
        a, b = ([f"w{draw.randrange(6)}" for _ in range(draw.randint(1, 25))] for _ in range(2))
        x, y = (word_hashes([" ".join(w)])[0] for w in (a, b))
        assert decontaminate.align(x, y)[0] == smith_waterman(a, b)


def leaks():
    draw = random.Random(6)
    sentence = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    items = [sentence(30) for _ in range(6)]
    rows, wanted = [], {}
    for i in range(80):
        w = sentence(120)
        if i % 4 == 0:
            k, at = i // 4 % 6, draw.randrange(100)
            copy = [x if draw.random() > 0.12 else f"e{draw.randrange(3000)}" for x in items[k]]
            w[at:at] = copy
            wanted[i] = k
        rows.append((i, " ".join(w)))
    return [(k, " ".join(x)) for k, x in enumerate(items)], rows, wanted


def test_edited_copies_are_found_and_clean_texts_left(spark, docs):
    items, rows, wanted = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 200):
        got = {r.doc_id: (r.item_id, r.score) for r in decontaminate.contaminated(docs(rows), bench, block_chars=block).collect()}
        assert {k: v[0] for k, v in got.items()} == wanted and min(v[1] for v in got.values()) >= 0.5
    assert decontaminate.clean(docs(rows), bench).count() == 80 - len(wanted)


def test_an_item_in_most_texts_is_found_in_each(spark, docs):
    items, _, _ = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"own{i} " + items[0][1] + f" end{i}") for i in range(60)]
    assert decontaminate.contaminated(docs(rows), bench).count() == 60


def test_an_edited_copy_in_many_texts_is_found_in_each(spark, docs):
    words = [f"w{k}" for k in range(30)]
    copy = " ".join("edited" if k in (9, 20) else w for k, w in enumerate(words))
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    rows = [(i, f"own{i} {copy} end{i}" if i % 2 else f"other{i} text of its own") for i in range(120)]
    got = decontaminate.contaminated(docs(rows), bench).collect()
    assert len(got) == 60 and all(abs(r.score - 0.9) < 1e-9 for r in got)


def best_scores(rows, items, least):
    """Best alignment of every pair of rows that share a seed, by the table over whole texts: {(doc_id, item_id): score}."""
    out = {}
    for i, t in rows:
        for k, x in items:
            a, b = (WORD_RE.findall((y or "").lower()) for y in (x, t))
            n = min(4, len(a))
            seeds = {tuple(a[j : j + n]) for j in range(len(a) - n + 1)}
            if a and any(tuple(b[j : j + n]) in seeds for j in range(len(b) - n + 1)) and (score := smith_waterman(a, b) / (2 * len(a))) >= least:
                out[i, k] = max(score, out.get((i, k), 0))
    return out


def test_the_query_against_all_pairs(spark, docs):
    """Whole texts against whole items, ids repeated on both sides, copies of all lengths and degrees of editing."""
    draw = random.Random(21)
    sentence = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    items = [(draw.randrange(6), sentence(draw.choice([3, 8, 20, 40]))) for _ in range(12)]
    rows = []
    for i in range(150):
        w = sentence(draw.randint(0, 120))
        for _ in range(draw.randint(0, 2)):
            x = draw.choice(items)[1]
            share = draw.choice([0, 0, 0.1, 0.2])
            w[(at := draw.randint(0, len(w))) : at] = [y if draw.random() >= share else f"e{draw.randrange(99)}" for y in x if draw.random() > share / 3]
        rows.append((draw.randrange(100), " ".join(w)))
    items = [(k, " ".join(x)) for k, x in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = best_scores(rows, items, 0.5)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert set(got) == set(wanted) and all(abs(got[x] - wanted[x]) < 1e-9 for x in got)
    assert got == {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(rows), bench, block_chars=100).collect()}


@pytest.mark.parametrize("share, least", [(0.05, 1.0), (0.1, 0.99), (0.15, 0.97)])
def test_recall_on_edited_copies(spark, docs, share, least):
    """Items of 30 words of which a share is replaced: those whose copy still scores half are to be found."""
    draw = random.Random(22)
    items = [(k, [f"i{k}w{j}" for j in range(30)]) for k in range(300)]
    rows = [(k, [w if draw.random() >= share else f"e{draw.randrange(9999)}" for w in x]) for k, x in items]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = decontaminate.contaminated(docs([(k, "a b c d " + " ".join(x) + " e f g h") for k, x in rows]), bench)
    wanted = sum(smith_waterman(x, y) >= 30 for (_, x), (_, y) in zip(items, rows))
    assert got.count() / wanted >= least


def test_items_and_texts_that_repeat_ids(spark, docs):
    bench = spark.createDataFrame([(0, "a b c d e f g h"), (0, "i j k l m n o p"), (0, "a b c d e f g h")], "item_id long, text string")
    rows = [(1, "a b c d e f g h"), (1, "clean text of it"), (2, "x i j k l m n o p y"), (None, "a b c d e f g h"), (None, "clean too it is")]
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs(rows), bench).collect()), key=repr)
    assert got == [(1, 0, 1.0), (2, 0, 1.0), (None, 0, 1.0)]
    assert sorted(r.text for r in decontaminate.clean(docs(rows), bench).collect()) == ["clean text of it", "clean too it is"]


def test_decontamination_of_defined_cases(spark, docs, clashing):
    bench = spark.createDataFrame([(0, "a b c d e f g h"), (1, None), (2, ""), (None, "x y z w v"), (3, "two words")], "item_id long, text string")
    rows = [(None, "a b c d e f g h"), (1, None), (2, ""), (3, "Say: A b, c d E f g h!"), (3, "Say: A b, c d E f g h!"), (4, "two words"), (5, "word " * 50_000)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(clashing(rows), bench).collect()}
    assert got == {(None, 0), (3, 0), (4, 3)}
    assert sorted(r.doc_id for r in decontaminate.clean(clashing(rows), bench).collect()) == [1, 2, 5]
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(docs(rows), bench.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9_ .é漢\n-"), max_size=20), max_size=6))
def test_words_of_texts(texts):
    hashed, at = word_hashes(texts)
    words = [WORD_RE.findall(t.lower()) for t in texts]
    assert [int(at[i + 1] - at[i]) for i in range(len(texts))] == [len(w) for w in words]
    seen: dict[str, int] = {}
    for w, h in zip([x for ws in words for x in ws], hashed.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
