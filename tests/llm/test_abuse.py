import random

import held_out
import pytest

from tidepath.llm import abuse
from tidepath.llm.mail import visible

LEX = abuse.Lexicon()


def case(text):
    return abuse.score(text, LEX, {})[0] >= 1


def edits(a, b):
    """Optimal string alignment distance, `*` in b matching any letter."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1] and b[j - 1] != "*"))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force():
    words = sorted({"idiot", "imbecile", "parasite", "worthless", "stupid", "clown", "pig", "vermin", "vermine"})
    trie, rng = abuse.Trie(words), random.Random(0)
    for _ in range(400):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(w) + 1)
            w[k - 1 : k] = rng.choice([[], [rng.choice("abeirst*")], [w[k - 1], rng.choice("aeo")]]) if k > 1 else w[:1]
        w = "".join(w)
        for most in (0, 1, 2):
            want = {(x, edits(x, w)) for x in words if x[0] == w[0] and edits(x, w) <= most}
            assert set(trie.walk(w, most)) == want


@pytest.mark.parametrize("text", [
    "You are a stupid halfwit, Lysovar.", "If Jorane weren't such a dickhead, it would run.", "Those old people are v3rm1n and should be driven out.", "You absolute, pathetic, worthless p.a.r.a.s.i.t.e.",
    "I want to lick your p u s s y .", "🖕 Wexiku 🖕 you spineless сlоwn", "Go f**k yourself, Ilviku", "Somebody should put a bullet in Ardovar.", "I keep picturing you nakeeeeeeeed on my desk with your legs apart", "Ferme ta gueule, espèce de crétin.",
    "Verpiss dich, du Vollidiot, sonst schlag ich dir die Zähne ein.", "你去死吧，没人会想你。", "ヴェルマ人は害虫だ、全員追い出せ。", "You st​upid hal­fwit.", "Only a useless imbecille like you could have signed it off",
])
def test_cases(text):
    assert case(text)


@pytest.mark.parametrize("text", [
    "", "Fuck, the build is red again, will fix it after lunch.", "I'm such an idiot, I forgot the attachment again.", "Ich Idiot habe die Tabelle vergessen.", "Cette machine est idiote, elle s'arrête chaque nuit.", "It's a bitch to configure, but the export runs now.",
    "The cock crows at five on the farm where we hold the retreat.", "Sexbrook will present the pussy willow planting plan.", "Just kill the child process and its orphan, then the master node comes back.", "This bloody printer is a piece of crap, it ate the report twice.",
    "The new policy on abusive language and sexual harassment applies from Monday", "A dead stupid bug: the loop starts at one.", "我真笨，忘了表格。", "馬鹿な間違いで表を消してしまいました。", "Execute the hanging jobs first, then strip the naked quotes from the header.", "Kind regards, if you have time", "Das Dickicht an Regeln ist dumm, aber wir halten uns daran.",
])
def test_no_cases(text):
    assert not case(text)


def test_every_entry_fires():
    for term in LEX.terms:
        assert term in LEX.near(term)
        assert abuse.score(f"you {term}", LEX, {})[0] >= 0.7, term
    for kind, p in LEX.phrases:
        text = " ".join("those old people" if w == "group" else w for w in p)
        assert abuse.score(text, LEX, {})[0] >= (1 if len(p) > 1 else 0.6), text


@pytest.mark.parametrize("text", ["you jerk", "you coward", "I'll cut that grin off", "shut your mouth", "Shut the fuck up"])
def test_entries_that_are_plain_words(text):
    assert case(text)


@pytest.mark.parametrize("text", ["do this again, you moron", "Read this, you stupid idiot.", "It's your fault, you imbecile", "It's an idiot like you who broke it"])
def test_this_and_its_do_not_hide_an_insult(text):
    assert case(text)


@pytest.mark.parametrize("text", ["It's a bitch to configure, you will see", "This is such a bitch to set up, your call", "this bitch of a build runs now"])
def test_this_and_its_said_of_a_thing(text):
    assert not case(text)


@pytest.mark.parametrize("text", [
    "You idoit.", "you morron", "you biitch", "you whoore", "You jdiot", "you vmbecile", "what a losre you are", "you scumm", "you st*ppid moron", "you *idiot*", "you cretin" + "n" * 60, "wacth your bakc, wacth your back", "put a bulet in him",
])
def test_misspelled(text):
    assert case(text)


@pytest.mark.parametrize("text", ["What is that, you said", "your fifth bench", "you use a lower price than your banker", "the crown you gave", "are you discussing it", "my disk, your desk", "I will fill you in", "you are right, switch it", "what a slot you picked", "we third you"])
def test_near_words_are_no_misspelling(text):
    assert not case(text)


@pytest.mark.parametrize("text", [
    "I'm going to break your fingers one by one", "I hope he gets hit by a truck", "You deserve to be whipped.", "I know where you park", "These foreigners are all criminals", "All immigrants should be deported", "go back to your own hole",
    "I dream of undressing you", "take off your bra", "he stroked her tits", "You are a complete embarrassment", "nobody on this team would miss you, no one likes you",
])
def test_wordings_that_no_phrase_holds(text):
    assert case(text)


@pytest.mark.parametrize("text", ["We hope you didn't suffer from the outage.", "Will you take your dress shirt to the cleaner?", "We'll kill your job at noon", "I'll break your change into two commits", "the logs are garbage", "Those people are waiting for you", "I hope the run never wakes up", "refugees should be given a form"])
def test_wordings_that_are_no_case(text):
    assert not case(text)


def test_prefilter_loses_no_word():
    rng = random.Random(1)
    words = [w for w in sorted(LEX.terms) if len(w) > 3]
    for _ in range(300):
        w = list(rng.choice(words))
        most = 2 if len(w) > 8 else 1
        for _ in range(most):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("aeirst")], [w[k], rng.choice("aeo")], [w[k], w[k]]])
        w = "".join(w)
        near = {x for x, _ in LEX.trie.walk(w, most, head=False)}
        assert not near or not LEX.reach[most].isdisjoint(abuse._cuts(w, most))


def test_visible_parts_only():
    mail = 'From: a <a@b.example>\r\nSubject: =?utf-8?B?WW91IGlkaW90?=\r\nContent-Type: multipart/mixed; boundary="xx"\r\n\r\n--xx\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>Sch=C3=B6n<b>e</b> Gr=\r\n=C3=BC&szlig;e</p>\r\n--xx\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nYWJj\r\n--xx--\r\n'
    assert visible(mail).split() == ["You", "idiot", "Schöne", "Grüße"]
    assert visible(None) == "" and visible("no header\n\nat all") .strip() == "no header\n\nat all"
    assert "cut" in visible("Subject: x\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nY3V0IG")


def test_documents_and_rates(spark):
    rows = [(1, "Subject: x\n\nYou are a stupid halfwit, Lysovar.", "Desk_Archive "), (2, None, None), (3, "", "desk-archive"), (3, "", "desk-archive"), (4, "fine " * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as score", "'x' as kind")
    s = abuse.score_documents(df)
    assert [(r.doc_id, r.score >= 1) for r in s.orderBy("doc_id").collect()] == [(1, True), (2, False), (3, False), (3, False), (4, False)]
    assert {(r.source, r.messages, r.cases) for r in abuse.rates(s).collect()} == {("desk-archive", 3, 1), ("(none)", 1, 0), ("", 1, 0)}
    assert abuse.score_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_multiparts_are_read_however_deep():
    text = "Content-Type: text/plain\n\nat the bottom"
    for k in range(40):
        text = f'Content-Type: multipart/mixed; boundary="b{k}x"\n\n--b{k}x\n{text}\n--b{k}x--\n'
    assert visible("Subject: s\n" + text).split() == ["s", "at", "the", "bottom"]


def found_of(sentences, lexicon):
    return [s for s in sentences if abuse.score(s, lexicon, {})[0] >= 1]


def test_held_out_sentences():
    lexicon = abuse.Lexicon()
    assert len(found_of(held_out.ABUSIVE, lexicon)) >= 0.8 * len(held_out.ABUSIVE)
    assert len(found_of(held_out.HARMLESS, lexicon)) <= 0.1 * len(held_out.HARMLESS)


def test_the_automaton_finds_what_exact_words_miss():
    class Exact(abuse.Lexicon):
        def near(self, token):
            return frozenset({token} & (self.exact | self.terms.keys()))

    assert len(found_of(held_out.ABUSIVE, Exact())) <= len(found_of(held_out.ABUSIVE, abuse.Lexicon())) - 3


def test_no_whole_sentences_in_the_lexicon():
    assert max(len(p) for _, p in abuse.Lexicon().phrases) <= 3


def test_words_however_long():
    lexicon = abuse.Lexicon()
    assert found_of(["you are such an idi" + "o" * 60 + "t", "you are such an iiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiidiot"], lexicon).__len__() == 2
    assert not found_of(["a" * 500 + "idiot", "x" * 100], lexicon)
