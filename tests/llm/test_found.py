"""The corpus operators against brute force, round trips and held-out data, with null, empty, long, repeated and clashing input."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import p1_lines, p2_garbled, p3_residue, p4_neardup, p5_content, p6_language, p7_chunks, p8_tokens, p9_mix, p10_subjects
from tests.conftest import rows

DATA = Path("/root/testdata/sf0.001")
TOKENIZER = Path(p8_tokens.TOKENIZERS) / "byte_bpe_50k.tiktoken"
SCRAPES = "scrape_id long, url string, markdown string, html string, text string, metadata struct<title:string,language:string>"
#: Columns whose names the operators use inside.
CLASH = ("key", "id", "n", "line", "host", "content", "block", "word", "rank", "label", "bands", "leaf", "part", "k", "value", "field")


def scrapes(spark, records):
    """records: dicts with scrape_id and any of the other columns; extra columns clash with names inside the operators."""
    filled = [tuple(r.get(c) for c in ("scrape_id", "url", "markdown", "html", "text")) + ((r.get("title"), r.get("language")) if "title" in r or "language" in r else None,) for r in records]
    df = spark.createDataFrame(filled, SCRAPES)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


# Problem 1


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["Share this 1!", "SHARE THIS", "[share](http://x/1) this", "Unique {}", "", "---", "2024", "ﬁn Ähre", None]
    records = []
    for i in range(120):
        md = "\n".join((rng.choice(pool[:-1]) or "").format("ab" * (i % 9)) for _ in range(6))
        url = rng.choice(["https://www.A.test:80/x", "http://a.test/y", "https://b.test", "no host", None])
        records.append({"scrape_id": i, "url": url, "markdown": rng.choice([md, md, md, None, ""])})
    groups = defaultdict(set)
    lines = []
    for r in records:
        host = {"https://www.A.test:80/x": "a.test", "http://a.test/y": "a.test", "https://b.test": "b.test"}.get(r["url"])
        for no, line in enumerate((r["markdown"] or "").split("\n")):
            key = " ".join(re.findall(r"[^\W\d_]+", re.sub(r"\]\([^)]*\)", "] ", line).lower()))
            if host and key:
                groups[host, key].add(r["scrape_id"])
                lines.append((host, key, r["scrape_id"], no))
    want = sorted((i, no) for h, k, i, no in lines if len(groups[h, k]) >= 5)
    df = scrapes(spark, records)
    assert rows(p1_lines.found(df)) == want and want
    assert p1_lines.found(df.limit(0)).count() == 0


def test_lines_incrementally(spark):
    df = scrapes(spark, [{"scrape_id": i, "url": "https://a.test/", "markdown": f"Same line\nOwn {'x' * i}"} for i in range(1, 9)])
    first, rest = df.where("scrape_id <= 3"), df.where("scrape_id > 3")
    state, crossed = p1_lines.merge(None, p1_lines.line_counts(first))
    assert crossed.count() == 0
    state, crossed = p1_lines.merge(state, p1_lines.line_counts(rest))
    assert crossed.count() == 1
    assert rows(state) == rows(p1_lines.merge(None, p1_lines.line_counts(df))[0])
    assert p1_lines.merge(state, p1_lines.line_counts(first))[1].count() == 0  # it crossed before
    rebuilt = p1_lines.rebuild(df, p1_lines.marked_lines(df, crossed))
    assert rebuilt.count() == 8 and {r.markdown for r in rebuilt.collect()} == {f"Own {'x' * i}" for i in range(1, 9)} and "key" in rebuilt.columns


def test_lines_of_partitions(spark):
    """A partition that comes after a line has crossed holds it too; lines cross with the second and the third one."""
    records = [{"scrape_id": i, "url": "https://a.test/", "markdown": f"Same line\nOwn {'x' * i}" + "\nLate line" * (i > 6)} for i in range(1, 13)]
    df = scrapes(spark, records)
    parts = [df.where(f"scrape_id between {a} and {b}") for a, b in ((1, 3), (4, 8), (9, 12))]
    assert rows(p1_lines.loaded(parts)) == rows(p1_lines.found(df)) == sorted([(i, 0) for i in range(1, 13)] + [(i, 2) for i in range(7, 13)])
    assert p1_lines.loaded([df.limit(0)]).count() == 0


def test_lines_in_order_of_ingestion(spark):
    times = ["2024-01-03", None, "2024-05-01", "2024-11-30", "2023-02-01", "2024-05-02"]
    df = scrapes(spark, [{"scrape_id": i, "url": "https://a.test/", "markdown": f"Same line\nOwn {'x' * i}\nSame line"} for i in range(12)])
    df = df.join(spark.createDataFrame([(i, times[i % 6]) for i in range(12)], "scrape_id long, t string"), "scrape_id").withColumn("ingested_at", F.col("t").cast("timestamp_ntz"))
    parts = p1_lines.partitions_of(df)
    assert len(parts) > 2 and sum(x.count() for x in parts) == 12
    assert rows(p1_lines.found(df, when="ingested_at")) == rows(p1_lines.found(df)) == sorted((i, k) for i in range(12) for k in (0, 2))
    assert p1_lines.found(df.limit(0), when="ingested_at").count() == 0


# Problem 2


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", ["Die Straße über Köln", "a naïve café – “quoted”", "São João não é", "Où est l’été"])
def test_garbled_round_trip(encoding, text):
    data = text.encode()
    garbled = p2_garbled._read(data, encoding)
    if garbled is None:
        pytest.skip("bytes that the encoding does not have")
    assert p2_garbled.affected(garbled) and p2_garbled.restore(garbled) == text
    mixed = f"Été correct. {garbled} Déjà vu."
    assert p2_garbled.restore(mixed) == f"Été correct. {text} Déjà vu."


@pytest.mark.parametrize("text", ["", "plain", "PIÙ LETTI È COSÌ", "UMA MANHÃ DE SOL", "2 ½ Tassen", "Œuvre à l'été, garçon ÉTÉ", "the bytes “Ã©” and `â€™` are shown", "Preis: 40 €, »so« und „so“", "what? yes. a page?id=1&x=2", "© 2024 · Übersicht › Ärzte", "what?no", "Is it?yes it is", "(x,σx)", "Рёбра и «СССР»", "Η κυβέρνηση", "政府は本日", "Łódź jest piękna", "Příliš žluťoučký kůň, knížka", "Ærø ÅRHUS"])
def test_correct_text_is_left_alone(text):
    assert not p2_garbled.affected(text) and p2_garbled.restore(text) == text


@pytest.mark.parametrize(
    ("text", "written_as", "read_as"),
    [
        ("Правительство утвердило новый закон", "utf-8", "cp1251"), ("Правительство утвердило новый закон", "utf-8", "latin-1"), ("Правительство утвердило новый закон", "cp1251", "cp1252"), ("Правительство утвердило новый закон", "koi8-r", "cp1252"),
        ("Η κυβέρνηση ενέκρινε νέο νόμο", "utf-8", "cp1252"), ("Η κυβέρνηση ενέκρινε νέο νόμο", "iso8859-7", "cp1252"), ("政府は本日新しい法律を承認しました", "utf-8", "cp1252"), ("政府は本日新しい法律を承認しました", "shift_jis", "cp1252"),
        ("Łódź jest piękna", "utf-8", "cp1252"), ("Łódź jest piękna", "utf-8", "latin-1"), ("政府今天通过了一项新的法律", "gb2312", "cp1252"), ("정부는 오늘 새로운 법률을 승인했다", "euc_kr", "latin-1"),
    ],
)
def test_other_scripts_round_trip(text, written_as, read_as):
    garbled = p2_garbled._read(text.encode(written_as), read_as)
    assert p2_garbled.affected(garbled) and p2_garbled.restore(garbled) == text
    assert p2_garbled.restore(f"Plain words. {garbled} More words.") == f"Plain words. {text} More words."


def test_lossy_text_is_reported(spark):
    df = scrapes(spark, [{"scrape_id": 1, "text": "caf� owner", "title": "ok"}, {"scrape_id": 2, "text": None, "title": "CafÃ©"}, {"scrape_id": 3, "text": "b?squeda"}, {"scrape_id": 4, "text": "x" * 100_000}, {"scrape_id": 2, "text": None, "title": "CafÃ©"}, {"scrape_id": None, "text": "CafÃ©"}])
    assert set(rows(p2_garbled.found(df))) == {(1, "text"), (2, "title"), (3, "text")}
    known = {(r.scrape_id, r.known) for r in p2_garbled.repaired(df.where("scrape_id is not null")).collect()}
    assert known == {(1, False), (2, True), (3, False)} and p2_garbled.found(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc éàüñßç’–“”\n", max_size=40))
def test_garbled_property(text):
    """What UTF-8 read as cp1252 makes of a text is always found and always comes back."""
    garbled = p2_garbled._read(text.encode(), "cp1252")
    if garbled != text and not text.isascii():
        assert p2_garbled.restore(garbled).replace(" ", " ") == text.replace(" ", " ")


# Problem 3

LONG = "This is a proper article about many things, and it goes on for long enough to count as one. " * 5


@pytest.mark.parametrize(
    ("text", "html", "case"),
    [
        ("Page not found. The address a.test/x does not exist or has been moved. Error 404", None, True),
        ("Menu\nSeite nicht gefunden. Die Adresse x gibt es nicht", None, True),
        (LONG + "\nThe server said “access denied” 110 times.", None, False),
        ("Dear {{ user.name }}, hello. " + LONG, None, True),
        (LONG + " In the guide the field `{{ user.name }}` is replaced.", None, False),
        (LONG + "\n<h1>{{ title }}</h1> Name", None, False),
        (LONG + "\nreturn f({a: (b), c: {d: 1}})", None, False),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit", None, True),
        (LONG + " Printers use “lorem ipsum dolor sit amet” as a sample.", None, False),
        ("Your headline goes here (3)\nMore", None, True),
        (None, "<body><noscript>Please enable JavaScript</noscript><div id=app></div></body>", True),
        ("", f"<body><noscript>Please enable JavaScript</noscript><p>{LONG}</p></body>", False),
        (None, f"<body><script>var x='{{{{a}}}}'</script><p>{LONG}</p></body>", False),
        (None, None, False),
        ("   ", None, False),
    ],
)
def test_residue(spark, text, html, case):
    df = scrapes(spark, [{"scrape_id": 1, "text": text, "html": html}] * 2)
    assert rows(p3_residue.found(df)) == ([(1,)] if case else [])


def test_templates(spark):
    """A verdict reaches other fillings of a slot, and no other sentence."""
    texts = [f"Bad gateway: the upstream server at {x} sent no valid reply" for x in ("alpha", "beta")] + ["Bad gateway: the upstream gate is old stone work", "Your session has expired please", "quite another line"]
    df = scrapes(spark, [{"scrape_id": i, "text": LONG + "\n" + t} for i, t in enumerate(texts)])
    assert rows(p3_residue.cases(df)) == [(0, "failed"), (1, "failed"), (3, "session")] or rows(p3_residue.cases(df)) == [(0, "failed"), (1, "failed"), (2, "failed"), (3, "session")]
    leaf, mask = p3_residue.Leaf(), p3_residue.Mask()
    for x in ("alpha", "beta"):
        leaf.place(mask(f"no valid reply from {x} today"), "failed", True, 1, 0, 0)
    assert len(leaf.templates) == 1 and leaf.templates[0].tokens[4] == p3_residue.WILD
    assert leaf.place(mask("no valid reply from gamma today"), None, False, 1, 0, 0) is leaf.templates[0]
    assert leaf.place(mask("no valid reply from gamma again"), None, False, 1, 0, 0) is None
    assert p3_residue.found(scrapes(spark, [])).count() == 0


#: Wordings that no list of the operator was made from.
UNSEEN = (
    "An unexpected error occurred", "Too many requests", "You have been blocked", "Please complete the security check to access", "502", "Sorry, we couldn't find that page", "Error 410: Gone", "Your request could not be processed",
    "We are unable to load this page right now.", "Ein unerwarteter Fehler ist aufgetreten.", "Trop de requêtes. Réessayez plus tard.", "Se ha producido un error inesperado", "Si è verificato un errore", "Er is een fout opgetreden", "Ocorreu um erro", "Request timed out", "Are you a robot?",
    "The server is currently unavailable", "Vous avez été bloqué", "Whoops! Unauthorized",
)


def test_unseen_wordings(spark):
    """Held-out wordings as the content of a record; beside an article they are none."""
    assert p3_residue.found(scrapes(spark, [{"scrape_id": i, "text": t} for i, t in enumerate(UNSEEN)])).count() >= 0.9 * len(UNSEEN)
    assert rows(p3_residue.found(scrapes(spark, [{"scrape_id": i, "text": f"{t}\n{LONG}\n{LONG[::-1]}"} for i, t in enumerate(UNSEEN)]))) == []


def test_long_messages_and_unknown_ones_on_error_pages(spark):
    long = "Something went wrong " + "while the machine that keeps this page was looking for it in the large cellar " * 8
    rows_ = [(1, long, 500, "a"), (2, LONG + "\n" + LONG + "\nSomething else", 200, "a")]
    rows_ += [(10 + i, "Det gick inte att visa sidan just nu", 503, "abc"[i % 3]) for i in range(4)] + [(20 + i, "Det gick bra att visa sidan just nu", 200, "abc"[i % 3]) for i in range(4)]
    df = spark.createDataFrame([(i, t, None, (None, None, s), f"https://{h}.test/{i}") for i, t, s, h in rows_], "scrape_id long, text string, html string, metadata struct<title:string,language:string,status_code:int>, url string")
    assert rows(p3_residue.found(df)) == [(1,), (10,), (11,), (12,), (13,)]


def test_messages_beside_other_templates(spark):
    """A message keeps its verdict beside lines of its leaf that have none, and gives it to none of them."""
    texts = ["This site needs cookies to work", "This site needs maps to work", "This site needs scripts to work"]
    df = scrapes(spark, [{"scrape_id": i, "text": LONG + "\n" + t} for i, t in enumerate(texts)])
    assert rows(p3_residue.cases(df)) == [(2, "scripts")]


# Problem 4


def _jaccard_pairs(texts, t):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    out = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                out.append((a, b))
    return sorted(out)


def _variants(rng, n):
    texts = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(80)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            v = list(words)
            for _ in range(rng.randrange(8)):
                v[rng.randrange(len(v))] = "edited" + str(rng.randrange(9))
            texts.append(" ".join(v))
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = list(enumerate([*_variants(random.Random(5), 25), None, "", "two words", "just three words", "just three words", "JUST, three words!", "x " * 50_000]))
    df = scrapes(spark, [{"scrape_id": i, "markdown": t} for i, t in texts])
    want = _jaccard_pairs(texts, 0.6)
    assert rows(p4_neardup.found(df)) == want and len(want) > 10
    assert rows(p4_neardup.found(df.union(df.limit(3)))) == want
    assert p4_neardup.found(df.limit(0)).count() == 0
    groups = {r.id: r for r in p4_neardup.groups(*p4_neardup.similar_pairs(df)).collect()}
    links = defaultdict(int)
    for a, b in want:
        assert groups[a].group == groups[b].group
        links[a] += 1
        links[b] += 1
    assert all(r.links == links[i] for i, r in groups.items())


def test_long_chains_settle(spark):
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "rep_a long, rep_b long, similarity double")
    members = spark.range(61).select(F.col("id").alias("rep"), "id")
    got = p4_neardup.groups(pairs, members)
    assert {r.group for r in got.collect()} == {0} and got.where("links = 2").count() == 59


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 4000)).astype(np.uint64)
    b[:3000] = a[:3000]  # 3000 of 5000
    u, v = p4_neardup.sketch(a, 320), p4_neardup.sketch(b, 320)
    assert (np.maximum(u, v) == p4_neardup.sketch(np.union1d(a, b), 320)).all()
    got = p4_neardup.estimate(u[None], v[None], np.array([4000.0]), np.array([4000.0]))[0]
    assert abs(got - 0.6) < 0.1


# Problem 5


def _page(k, shell):
    """(html, markdown, lines that are not of the article) of a page whose article differs in shape from page to page."""
    rng = random.Random(k)
    parts = [("h1", f"Title {'abcdefgh'[k % 8] * (k // 8 + 2)}")]
    for j in range(rng.randrange(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul"])
        text = f"Paragraph {'abcdefgh'[k % 8] * (k // 8 + 2)} {'xyzuvw'[j % 6] * (j + 1)} says that {'some of ' * rng.randrange(1, 9)}the matter is plain enough for all."
        parts.append((kind, text if kind == "p" else f"Part {text[10:16]}" if kind == "h2" else [f"item {text[10:20]} {i}" for i in range(rng.randrange(1, 4))]))
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News"))
    body = "".join(f"<ul>{''.join(f'<li>{i}</li>' for i in t)}</ul>" if kind == "ul" else f"<{kind}>{t}</{kind}>" for kind, t in parts)
    html = f"<html><body><div class='top{shell}'><ul>{menu}</ul></div><div class='main{shell}'>{body}<div class='ad{shell}'><p>Share this page</p></div></div><div class='end{shell}'><p>All rights reserved</p></div></body></html>"
    md = ["- [Home](/Home)", "- [News](/News)", ""]
    for kind, t in parts:
        md += [f"- {i}" for i in t] if kind == "ul" else [{"h1": "# ", "h2": "## ", "p": ""}[kind] + t]
        md.append("")
    md += ["**Share this page**", "", "All rights reserved"]
    away = {i for i, x in enumerate(md) if x in ("- [Home](/Home)", "- [News](/News)", "**Share this page**", "All rights reserved")}
    return html, "\n".join(md), away


def test_content(spark):
    records, want = [], []
    for k in range(40):
        html, md, away = _page(k, "aa1" if k < 34 else "bb2")
        only = k % 5 == 4
        records.append({"scrape_id": k, "url": f"https://{'a' if k < 34 else 'b'}.test/{k}", "markdown": md, "html": None if only else html})
        want += [(k, i) for i in away]
    records += [{"scrape_id": 90, "markdown": None, "html": "<p>x"}, {"scrape_id": 91, "url": None, "markdown": "", "html": None}]
    got = rows(p5_content.found(scrapes(spark, records)))
    assert len(set(got) ^ set(want)) <= 0.02 * len(want)
    assert p5_content.found(scrapes(spark, [])).count() == 0
    assert p5_content.found(scrapes(spark, [{"scrape_id": 1, "markdown": "# A\n\nb", "html": None}])).count() == 0
    df = scrapes(spark, records[:6]).select(F.col("scrape_id").alias("id"), "markdown")
    away = spark.createDataFrame([w for w in want if w[0] < 6], "id long, line_no int")
    assert all("Share" not in r.article for r in p5_content.article(df, away).collect())


def test_content_of_markdown_only_pages(spark):
    """Furniture in the shape of a paragraph is found where the page has no html, in long pages too."""
    notice = "Readers who leave a letter with the clerk agree that it may be shown in the hall for as long as the hall stands open to them all."
    records, want = [], []
    for k in range(60):
        html, md, away = _page(k, "aa1")
        if k >= 30:
            long = f"Paragraph {'abcdefgh'[k % 8] * (k // 8 + 2)} is long. " + "It goes on and on. " * (1100 + k)
            first, title, rest = re.split(r"(?m)(^# .*\n\n)", md)
            md = f"{first}{title}{long}\n\n{notice}\n\n{rest}"
            html = html.replace("</h1>", f"</h1><p>{long}</p><div class='hall'><p>{notice}</p></div>", 1)
        only = k >= 30 and k % 5 == 4
        records.append({"scrape_id": k, "url": f"https://{'a' if k < 30 else 'b'}.test/{k}", "markdown": md, "html": None if only else html})
        want += [(k, i) for i, x in enumerate(md.split("\n")) if only and x in ("- [Home](/Home)", "- [News](/News)", notice, "**Share this page**", "All rights reserved")]
    got = p5_content.found(scrapes(spark, records)).where("scrape_id >= 30 and scrape_id % 5 = 4")
    assert rows(got) == sorted(want) and want


def test_lines_that_hosts_disagree_about(spark):
    judged = spark.createDataFrame([(1, "a", 0, 7, False), (1, "a", 1, 8, False), (1, "a", 2, 9, True), (1, "a", 3, None, True), (2, "b", 0, 7, False)], "id long, host string, line_no int, key long, away boolean")
    labels = spark.createDataFrame([("a", [7, 8, None], False), ("a", [8, 9], True)], "host string, keys array<long>, kept boolean")
    assert rows(p5_content.settled(judged, labels)) == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True), (2, 0, False)]
    assert rows(p5_content.settled(judged, labels.limit(0))) == rows(judged.select("id", "line_no", "away"))


def test_branches_of_broken_html():
    got = p5_content.branches("<body><nav><p>A<p>B</nav><table width=1><tr><td class=x><h1>T</h1><p>one<p>two<ul><li>i<li>j</ul></td></tr></table><table><tr><td>c<td>d<tr><td>e</table>")
    assert [(b.path, b.shape) for b in got] == [("", ["nav", "td", "tr", "tr"]), ("/nav", ["p", "p"]), ("/td class=x", ["h1", "p", "p", "li", "li"])]


# Problem 6

WORDS = {
    "en": "the quick report says that nobody would have expected this to happen when they were still there with us and the others",
    "de": "der schnelle bericht sagt dass niemand das erwartet hätte als sie noch mit uns und den anderen dort waren und wie sich",
    "nl": "het snelle verslag zegt dat niemand dit had verwacht toen zij nog met ons en de anderen daar waren en hoe het zich",
    "fr": "le rapport dit que personne ne pensait que cela pouvait arriver quand ils étaient encore là avec nous et les autres",
    "es": "el informe dice que nadie esperaba que esto pudiera pasar cuando todavía estaban allí con nosotros y los demás según",
    "it": "la relazione dice che nessuno si aspettava che questo potesse accadere quando erano ancora lì con noi e gli altri però",
    "pt": "o relatório diz que ninguém esperava que isto pudesse acontecer quando ainda estavam lá connosco e os outros também não",
}


def _prose(rng, language, n=2):
    out = []
    for _ in range(n):
        w = WORDS[language].split()
        rng.shuffle(w)
        out.append(" ".join(w).capitalize() + ".")
    return " ".join(out)


def _labelled(rng, n=12):
    forms = {"en": "en-GB", "de": "Deutsch", "nl": "nld", "fr": "FR", "es": "es-419", "it": "it", "pt": "pt_BR"}
    return [{"scrape_id": i, "language": forms[x], "text": "\n".join(_prose(rng, x) for _ in range(4))} for i, x in enumerate(list(WORDS) * n)]


def test_languages(spark):
    rng = random.Random(2)
    records = _labelled(rng)
    n = len(records)
    cases = [
        {"scrape_id": n, "language": None, "text": _prose(rng, "fr", 3)},
        {"scrape_id": n + 1, "language": "und", "text": _prose(rng, "de", 3)},
        {"scrape_id": n + 2, "language": "en", "text": _prose(rng, "it", 3)},
        {"scrape_id": n + 3, "language": "en", "text": "\n".join([_prose(rng, "en", 3), _prose(rng, "de", 2), _prose(rng, "en", 3)])},
        {"scrape_id": n + 4, "language": "en", "text": _prose(rng, "en", 5) + " " + _prose(rng, "de", 1)},
        {"scrape_id": n + 5, "language": None, "text": None},
        {"scrape_id": n + 6, "text": "  "},
        {"scrape_id": n + 7, "language": None, "text": _prose(rng, "es", 3)},
    ]
    left_out = spark.createDataFrame([(n + 7,)], "scrape_id long")
    df = scrapes(spark, records + cases)
    assert rows(p6_language.found(df.union(df.where(f"scrape_id = {n}")), left_out)) == [(n, "fr"), (n + 1, "de"), (n + 2, "it"), (n + 3, "de"), (n + 3, "en")]
    assert p6_language.found(scrapes(spark, []), left_out).count() == 0


def test_language_labels(spark):
    forms = ["en", "EN", "en-US", "eng", "English", "Deutsch", "fr_CA", "français", "x-default", "und", "", None, "sv", "pt-BR", "Nederlands"]
    df = spark.createDataFrame([(x,) for x in forms], "x string").select(p6_language.normal_label(F.col("x")))
    assert [r[0] for r in df.collect()] == ["en", "en", "en", "en", "en", "de", "fr", "fr", None, None, None, None, "sv", "pt", "nl"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_languages_held_out(spark):
    """Trained on labels that are wrong in part, judged on passages the fit has not seen."""
    docs = spark.read.parquet(str(DATA.parent / "sf0.01" / "documents.parquet"))
    rows_ = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text")
    model = p6_language.fit(rows_.where("pmod(id, 2) = 0"))
    judged = p6_language.languages(rows_.where("pmod(id, 2) = 1"), model).join(rows_, "id").where("label is not null")
    right, n = judged.where("main = label").count(), judged.count()
    assert right / n > 0.9  # the labels themselves are wrong in some


def test_every_passage_and_other_languages(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    table = spark.read.parquet(str(DATA.parent / "sf0.01" / "scrapes.parquet"))
    model = p6_language.fit(table.select(F.col("scrape_id").alias("id"), F.col("metadata.language").alias("label"), "text"))
    french = "Le gouvernement a adopté aujourd'hui une nouvelle loi qui oblige les entreprises à publier les salaires de leurs employés tous les mois de l'année."
    others = [
        "Regeringen har idag beslutat om en ny lag som tvingar företagen att redovisa hur mycket de betalar sina anställda varje månad under året.",
        "El govern ha aprovat avui una nova llei que obliga les empreses a publicar els sous dels seus treballadors durant tot l'any vinent.",
        "Правительство сегодня утвердило новый закон, который обязывает компании публиковать заработную плату своих сотрудников каждый месяц.",
        "政府は本日、企業に従業員の給与を毎月公表することを義務付ける新しい法律を承認しました。",
        "Rząd przyjął dzisiaj nową ustawę, która zobowiązuje przedsiębiorstwa do publikowania wynagrodzeń swoich pracowników w każdym miesiącu roku.",
    ]
    texts = [(0, f"{french}\n\nThe market was quiet today.\n42", None), *((i + 1, x, "sv") for i, x in enumerate(others)), (9, None, None), (10, "", "en"), (11, " \n", "en")]
    df = spark.createDataFrame(texts, "id long, text string, label string")
    got = {(r.id, r.line_no): r for r in p6_language.passages(df, model).collect()}
    assert set(got) == {(0, 0), (0, 2), *((i, 0) for i in range(1, 6))}
    assert got[0, 0].lang == "fr" and got[0, 2].lang == "en" and got[0, 0].confidence > 0.9 and all(0 <= r.confidence <= 1 for r in got.values())
    assert all(got[i, 0].lang == p6_language.OTHER for i in range(1, 6))
    assert all(r.main is None for r in p6_language.languages(df.where("id between 1 and 5"), model).collect())
    forms = spark.createDataFrame([("sv-SE",), ("Swedish",), ("und",), ("x-default",), ("",), (None,)], "x string")
    assert [r[0] for r in forms.select(p6_language.normal_label(F.col("x"))).collect()] == ["sv", "sv", None, None, None, None]


# Problem 7


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n{}()#é𝄞", max_size=400), st.integers(1, 40), st.integers(0, 39))
def test_pieces(text, limit, overlap):
    overlap %= limit
    spans = p7_chunks.pieces(text, limit, overlap)

    def size(x):
        return int(len(x) / (3.5 if sum(x.count(c) for c in "{}()") > 0.05 * len(x) else 4))

    assert all(size(text[a:b]) <= limit and a < b for a, b in spans)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
        if overlap:
            assert size(text[c:b]) >= overlap or c == a + 1 or c == b and set("{}()") & set(text)
    assert (len(spans) > 1) == (size(text) > limit)


def test_chunks(spark):
    text = "# Head\n\n" + "A sentence of some words here. " * 60
    df = scrapes(spark, [{"scrape_id": 1, "markdown": text}, {"scrape_id": 2, "markdown": None}, {"scrape_id": 3, "markdown": "short"}, {"scrape_id": 4, "markdown": "x" * 5000}])
    profiles = spark.createDataFrame([("a", 100, 10), ("b", 1000, None), ("c", None, 5)], "profile string, max_tokens int, overlap_tokens int")
    got = p7_chunks.chunk(df, profiles).collect()
    mine = sorted((r.piece_no, r.piece) for r in got if r.profile == "a" and r.scrape_id == 1)
    assert len(mine) > 3 and all(p.rstrip().endswith(".") for _, p in mine)
    assert rows(p7_chunks.found(df, profiles)) == [("a", 1), ("a", 4), ("b", 4)]
    assert p7_chunks.found(df.limit(0), profiles).count() == 0 and p7_chunks.found(df, profiles.limit(0)).count() == 0


@pytest.mark.parametrize("overlap", [60, 99])
def test_large_overlaps_are_kept(overlap):
    text = "A sentence of some words here. " * 60
    spans = p7_chunks.pieces(text, 100, overlap)
    assert all((b - c) // 4 >= overlap for (_, b), (c, _) in zip(spans, spans[1:])) and spans[-1][1] == len(text)
    with pytest.raises(ValueError):
        p7_chunks.pieces(text, 100, 100)


# Problem 8

needs_tokenizer = pytest.mark.skipif(not TOKENIZER.exists(), reason="no tokenizer files")


@needs_tokenizer
def test_ids_against_the_tokenizer(spark):
    import tiktoken

    from pagemill.llm.p8_tokens import encoding

    texts = [None, "", " ", "a", "Hello  world\n\n\tx", "it's we'll I'M", "<|endoftext|>", "é𝄞漢字   x​", "\x00\x1c\x85 \r\n", "a" * 3000, "1234567 ½ ²", "…!!!??", "word " * 20_000, "Hello  world\n\n\tx"]
    df = spark.createDataFrame([(i % 13, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("word", F.lit("w"))
    enc = tiktoken.Encoding("whole", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=encoding(str(TOKENIZER))._mergeable_ranks, special_tokens={})
    want = sorted((i % 13, enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    for block_chars in (10, 3_000_000):
        got = sorted((r.doc_id, list(r.ids)) for r in p8_tokens.encode(df, block_chars=block_chars, salt=2).collect())
        assert got == want
    lengths = sorted(r.n_tokens for r in p8_tokens.encode(df, lengths_only=True).collect())
    assert lengths == sorted(len(x) for _, x in want)
    back = p8_tokens.decode(p8_tokens.encode(df), spark)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)
    assert p8_tokens.encode(df.limit(0)).count() == 0


# Problem 9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 120))
def test_fill_reaches_the_best_sum_near_the_share(lengths, budget):
    n, c = (np.array(x) for x in zip(*sorted(lengths)))
    take = p9_mix.fill(n, c, budget)
    total = int((n * take).sum())
    assert (take >= 0).all() and (take <= c).all() and total <= max(budget, 0) or budget >= int((n * c).sum())
    sums = {0}
    for size, k in zip(n, c):
        sums = {s + size * j for s in sums for j in range(k + 1)}
    best = max(s for s in sums if s <= budget)
    assert best - total <= n.max()


def test_fill_with_many_lengths_stays_small():
    import tracemalloc

    n = np.arange(1, 50_001)
    tracemalloc.start()
    take = p9_mix.fill(n, np.ones(50_000, np.int64), 500_000_017)
    assert (n * take).sum() == 500_000_017 and tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    even = p9_mix.fill(n[1::2] * 1, np.full(25_000, 3), 999_999_999)
    assert (n[1::2] * even).sum() == 999_999_998


def test_mix(spark):
    docs = [(i, f"s{i % 3}", 5 + i % 7) for i in range(300)] + [(900, None, 50), (901, "other", 50), (902, "s0", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("s0", 1.0, 1), ("s1", 2.0, 1), ("s2", 9.0, 2), ("gone", 0.5, 3), ("s0", 0.1, 9), (None, 1.0, 1), ("zero", None, None)], "source string, target_weight double, max_uses int")
    total = sum(n for _, s, n in docs if s in ("s0", "s1", "s2"))
    own = {s: sum(n for _, x, n in docs if x == s) for s in ("s0", "s1", "s2")}
    want = [("gone",)] + [(s,) for s, w, u in (("s0", 1, 1), ("s1", 2, 1), ("s2", 9, 2)) if w / 12.5 * total > u * own[s]]
    assert rows(p9_mix.found(sized, targets)) == sorted(want)
    chosen = p9_mix.mix(sized, targets, seed=3)
    got = {r.source: (r.t, r.u) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t"), F.max("uses").alias("u")).collect()}
    shares = {r.source: r for r in p9_mix.shares(sized, targets).collect()}
    for s, cap in (("s0", 1), ("s1", 1), ("s2", 2)):
        budget = int({"s0": 1, "s1": 2, "s2": 9}[s] / 12.5 * total)
        assert got[s][0] <= budget and got[s][1] <= cap and got[s][0] == shares[s].tokens_in_mix
        assert budget - got[s][0] <= 11 or budget > cap * own[s]
    assert rows(chosen) == rows(p9_mix.mix(sized.repartition(5), targets, seed=3)) != rows(p9_mix.mix(sized, targets, seed=4))
    assert rows(p9_mix.found(sized.limit(0), targets)) == [] and p9_mix.found(sized, targets.limit(0)).count() == 0


# Problem 10

TOPICS = {"law": "court judge statute verdict appeal lawyer".split(), "food": "kitchen recipe butter oven dough pepper".split(), "sport": "goal match league coach race stadium".split()}


def _about(rng, subject, n=14):
    return " ".join(rng.choice(TOPICS[subject]) if rng.random() < 0.4 else rng.choice("the a was with and then after before said near".split()) for _ in range(n)) + " " + rng.choice(TOPICS[subject]) + "."


def test_subjects(spark):
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(240):
        main = rng.choice(list(TOPICS))
        other = rng.choice(list(TOPICS))
        parts = [main] * 4 + ([other] * 2 if i % 3 == 0 else [])
        docs.append((i, "# " + _about(rng, other) + "\n\n" + "\n\n".join(_about(rng, s) for s in parts), "en", rng.choice(["a.test", None]), f"https://a.test/{i}", None))
        truth[i] = set(parts)
    docs += [(900, None, "en", None, None, None), (901, "  ", None, None, None, None), (902, "© 2024 all rights reserved\nHome", "en", None, None, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, url string, title string").withColumn("subject", F.lit("clash")).withColumn("rank", F.lit(1))
    labels = [(i, s, "r") for i in range(0, 240, 3) for s in truth[i]] + [(1, "sport", "r"), (0, None, "r"), (None, "law", "r"), (5000, "law", "r")]
    labels = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    subjects = spark.createDataFrame([(s,) for s in TOPICS], "subject string")
    got = defaultdict(set)
    for r in p10_subjects.found(df, labels, subjects).collect():
        got[r.doc_id].add(r.subject)
    held_out = [i for i in range(240) if i % 3]
    assert sum(got[i] == truth[i] for i in held_out) / len(held_out) > 0.95
    assert not got[900] and not got[901] and not got[902]
    assert p10_subjects.found(df, labels.limit(0), subjects).count() == 0
    assert p10_subjects.found(df.limit(0), labels, subjects).count() == 0
    assert p10_subjects.found(df, labels, subjects.limit(0)).count() == 0


def test_written_tables_can_be_removed(spark):
    from pagemill.llm import common

    df = common.written(spark.range(3))
    path = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert df.count() == 3 and path.exists() and common.remove_written(spark) >= 1 and not path.exists()
