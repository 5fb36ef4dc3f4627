"""Splitting, personal information, leaks and residue."""

import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import leaks as K
from skein.llm import personal_info as P
from skein.llm import residue as R
from skein.llm import splitting as S


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Satz. ", "\n", "\n\n", "x", "日本。", "é", "  "]), max_size=300).map("".join), st.integers(20, 90), st.integers(0, 15))
def test_split_round_trip(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + "".join(p[min(overlap, len(q)) :] for q, p in zip(pieces, pieces[1:])) == text
    assert all(p.startswith(q[-overlap:] if overlap else "") for q, p in zip(pieces, pieces[1:]))
    assert len(pieces) == 1 or len(text) > limit


def test_split_boundaries():
    para = "\n\n".join(["a b c. " * 20] * 8)
    cuts = S.cut_points(para, 400, 50)
    assert all(para[c - 1].isspace() for c in cuts[1:-1])
    assert len(S.split_text("x" * 1000, 400, 50)) == 4


def test_split_items(spark):
    df = spark.createDataFrame([(1, "a" * 4001, "x"), (2, "b" * 4000, "x"), (3, None, "x"), (4, "", "x"), (1, "a" * 4001, "x"), (5, "w " * 60_000, "x")], "k bigint, t string, piece string")
    got = S.split_items(df, ["k"], "t").collect()
    assert {r.k for r in got} == {1, 5} and sum(r.k == 1 and r.piece_no == 0 for r in got) == 2
    whole = [r for r in sorted((r for r in got if r.k == 5), key=lambda r: r.piece_no)]
    assert "".join(r.piece[r.overlap :] for r in whole) == "w " * 60_000 and max(len(r.piece) for r in whole) <= 4000


def pii_corpus():
    rng = random.Random(2)
    given_, sur = ["Anna", "Jonas", "Lars", "Maria", "Zarvik", "Quintara", "Brelda"], [a + b for a in ("Vor", "Kel", "Dram", "Osk") for b in ("moor", "sen", "wick", "anter")]
    name = lambda: f"{rng.choice(given_)} {rng.choice(sur)}"
    forms = ["Author: {} <x@y.example>", "the ticket was opened by {} today", "deliver to {}, soon", "I paired with {} yesterday", "hi, {} again"]
    return [rng.choice(forms).format(name()) for _ in range(400)] + ["the router module is fine", "Bad Weather Report", None, ""] * 5


def test_personal_information(spark):
    texts = pii_corpus()
    cases = [
        ("write to Some.One+tag@mail.example now", {"email"}), ("jo at mail dot example dot org", {"email"}), ("contact=jo.d%40mail.example&p=1", {"email"}),
        ("remote git@forge.example:a/b.git", set()), ("pin kit@1.2.3", set()), ("call (360) 555-0186", {"phone"}), ("tel +49 30 23125 201.", {"phone"}), ("0033 1 99 00 15 96", {"phone"}),
        ("listening on 10.218.46.106:7045 at 2026-08-25T00:00:01Z build 2026-12-10.413 epoch 1741946540", set()), ("SSN 915-46-7106", {"id_number"}), ("passport no. ZY5049387", {"id_number"}),
        ("Steuer-ID 95 115 582 498.", {"id_number"}), ("ship to 21 Oldbarn Avenue, Nordau 8675", {"address"}), ("PO Box 8330, Vallebruna 7250", {"address"}), ("Mühlgrabenstraße 95a, 71235 Bad Kessling", {"address"}),
        ("8, avenue du Vieux-Saule, 89692 Valmerie", {"address"}), ("Calle del Almendral Viejo, 27, 8º B, 12416 Vallebruna", {"address"}), ("seen by Zarvik Vormoor there", {"person"}), ("then Kelsen, Brelda left", {"person"}),
        ("and QUINTARA OSKWICK too", {"person"}), ("opened by brelda dramsen today", {"person"}), ("the old router", set()),
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts + [c[0] for c in cases])]
    df = spark.createDataFrame(rows, "k bigint, text string, kind string")
    markers = P.learn(df)
    assert len(markers) == 1 and {"zarvik", "quintara", "brelda"} <= markers[0].given
    found = {}
    for r in P.mentions(df, ["k"], markers).collect():
        found.setdefault(r.k, set()).add(r["kind"])
    for i, (text, want) in enumerate(cases):
        assert found.get(len(texts) + i, set()) == want, text
    out = {r.k: r.text for r in P.redact(df, markers, ["text"]).collect()}
    assert out[len(texts)] == "write to [EMAIL] now" and out[len(texts) + len(cases) - 1] == "the old router"
    assert [out[i] for i, t in enumerate(texts) if not t] == [t for t in texts if not t]
    # in small blocks the same personal information is found by kind of shape
    assert P.mentions(df, ["k"], P.learn(df, most=50)).where("kind = 'email'").select("k").distinct().count() == P.mentions(df, ["k"], markers).where("kind = 'email'").select("k").distinct().count()
    assert P.mentions(df.limit(0), ["k"], P.learn(df.limit(0))).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "ÉTÉ", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(25)] + [(25, None), (26, ""), (27, "same same " * 20)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            src = (items[rng.randrange(25)][1]).split()
            n = rng.choice([8, 11, 12, 13, 20])
            a = rng.randrange(max(1, len(src) - n + 1))
            words[5:5] = [w.upper() if rng.random() < 0.3 else w for w in src[a : a + n]]
        docs.append((1000 + d, (", " if d % 2 else "\n").join(words)))
    docs += [(2000, None), (2001, ""), (2002, "same " * 30), (2003, docs[0][1])]
    grams = lambda t: {tuple(K.words(t)[i : i + 12]) for i in range(len(K.words(t)) - 11)}
    want = {(i, d) for i, t in items for d, x in docs if grams(t) & grams(x)}
    D, I = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, shingle string")  # noqa: E741
    for most in (K.MAX_SHINGLES, 60):
        got = [(r.item_id, r.doc_id) for r in K.leaks(D.drop("item_id"), I, most=most).collect()]
        assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert K.leaks(D.limit(0), I).count() == 0 and K.leaks(D, I.limit(0)).count() == 0


def test_residue(spark):
    real = ["The router reads twice from the cache and nobody noticed. We saw retries, then a clean run.", "Placeholders such as [NAME] are filled in by the renderer, see the table below. The parser is slower than the index.", "Our fixture used lorem ipsum as body text, and the ranker scored it above all others in the long run of tests."] * 40
    bad = ["Home | About\n\n404 Not Found\n\n© 2024 pages", "# {{ title }}\n\nOwner: TBD\nStatus: ${status}", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", "Seite nicht gefunden", "Dear @@NAME@@,\n\nyour session «id» finished on <%= date %>.", "Veuillez activer JavaScript pour continuer."]
    rows = [(i, t, 1) for i, t in enumerate(real + bad + [None, "", "  ", "Menu\nClose"])]
    got = {r.doc_id: r.kind for r in R.residue(spark.createDataFrame(rows, "doc_id bigint, text string, coverage int")).collect()}
    assert set(got) == set(range(len(real), len(real) + len(bad)))
    assert got[len(real)] == "error" and got[len(real) + 1] == "form" and got[len(real) + 2] == "script"
    assert R.residue(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_residue_as_a_third_of_the_rows(spark):
    real = [f"Report {w}: the router reads twice from the cache, and nobody noticed {w} before the parser was slow." for w in ("".join(c) for c in itertools.product("wyzqkvj", repeat=3))]
    for text in ("Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Menu\nClose\n\nOops! This file is no longer here.\n\n© 2024 pages", "Please enable JavaScript to view this page."):
        for copies in (1, len(real) // 28, len(real) // 2):
            rows = list(enumerate(real + [text] * copies))
            got = {r.doc_id for r in R.residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
            assert got == set(range(len(real), len(rows))), (text, copies)


def test_nearest_exemplars_against_brute_force():
    rng = random.Random(6)
    vocab = [f"w{chr(97 + i)}" for i in range(20)]
    exemplars = [(rng.choice("xyz"), " ".join(rng.choices(vocab, k=rng.randrange(1, 7)))) for _ in range(40)]
    weight = {w: rng.choice([0.125, 1.0, 3.0]) for w in vocab}
    index, reached = R.Index(exemplars, weight, 2.0), 0
    for _ in range(1500):
        words = rng.sample(vocab, k=rng.randrange(1, 8)) + rng.sample(["router", "cache"], k=rng.randrange(0, 3))
        value = {w: weight.get(w, 2.0) for w in words}
        want = 0.0
        for kind in "xyz":
            held, left = 0.0, dict(value)
            for nth in range(max(1, min(R.NEAREST, len(value) // 2))):
                gains = [(sum(x for w, x in left.items() if w in e.split()), -i) for i, (k, e) in enumerate(exemplars) if k == kind]
                gain, i = max(gains, default=(0.0, 0))
                if nth == 0 and gain < R.ALONE * sum(value.values()):
                    break
                held, left = held + gain, {w: x for w, x in left.items() if w not in exemplars[-i][1].split()}
            want = max(want, held / sum(value.values()))
        got = index.best(words)[0]
        assert abs(got - want) < 1e-9 if want >= R.CONTAINMENT else got < R.CONTAINMENT
        reached += want >= R.CONTAINMENT
    assert 300 < reached < 1400


#: Wordings that thresholds and exemplars were chosen with in view; none is an exemplar.
UNSEEN = [
    "We couldn't find the page you were looking for. It may have moved, or the link might be broken.",
    '504 Gateway Time-out\nnginx',
    "Hi [Name],\n\nI'm writing to follow up on [topic]. Let me know if [date] works for you.\n\nBest,\n[Your Name]",
    'JavaScript must be turned on before you can proceed.',
    'Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus.',
    'Whoops! Looks like this page went missing.\nGo home',
    'The resource cannot be displayed right now. Try refreshing the page.',
    '<your name>\n<your address>\n<city>, <state>\n\nDear <recipient>,',
    'Invoice no: ____\nCustomer: ____\nTotal due: ____',
    'Access to this page has been denied because we believe you are using automation tools to browse the website.',
    'Internal error. The server was unable to process the request.',
    "This page doesn't exist anymore. You can return to our homepage.",
    "You don't have access to this document. Request access or switch accounts.",
    'Sorry, you need JavaScript enabled in your browser to use this website.',
    'This site relies on JavaScript. Turn on JavaScript in the settings of your browser and refresh.',
    "Your browser has JavaScript disabled, so this page can't be loaded.",
    'Leider ist ein Fehler aufgetreten. Die Seite kann nicht angezeigt werden.',
    'Um diese Website nutzen zu können, muss JavaScript im Browser aktiviert sein.',
    'Esta página no está disponible. Es posible que el enlace esté roto.',
    'Debe activar JavaScript en su navegador para usar este sitio.',
    "Cette page n'est plus disponible. Retour à l'accueil.",
    'Pour utiliser ce site, JavaScript doit être activé dans votre navigateur.',
    'Title: [Insert title]\nAuthor: [Insert author]\nDate: [Insert date]\n\n[Write your introduction here]',
    'Meeting: TBD\nLocation: TBD\nAttendees: TBD',
    'Lorem ipsum dolor sit amet consectetur. Aliquam erat volutpat. Nulla facilisi. Donec vitae sapien ut libero venenatis faucibus.',
    'The connection was reset. The site could be temporarily unavailable or too busy.',
    'Error 500. Something unexpected happened on the server.',
    "We're down for scheduled maintenance. Please check back soon.",
    'This account has been suspended. Contact your hosting provider for more information.',
    'Too many login attempts. Please wait 15 minutes and try again.',
    'Hello {{customer.name}},\n\nYour order {{order.id}} has been shipped and will arrive on {{order.date}}.\n\nThanks,\n{{shop.name}}',
    'This text is a placeholder. Replace it with your own content.',
    'Sample page\n\nThis is an example page. Add your own text here.',
    'Hier steht Ihr Text. Blindtext, der später ersetzt wird.',
    'Checking if the site connection is secure. Enable JavaScript and cookies to continue.',
    'You are being redirected. JavaScript is required.',
    'HTTP 403: you are not allowed to view this resource.',
    'Fatal error: the page could not be rendered. Please contact support.',
    'La página solicitada no se encuentra en este servidor.',
    "Le serveur a rencontré une erreur interne et n'a pas pu traiter la demande.",
    'Sorry! This listing has expired or been taken down.\n\nBrowse similar items',
    '502 - Web server received an invalid response while acting as a gateway or proxy server.',
    'Dear [Customer Name],\n\nWe noticed that your subscription to [Product] expires on [Expiry Date].\n\nWarm regards,\n[Agent]',
    'You have JavaScript switched off. Please switch it on to see this content.',
    'Cras ultricies ligula sed magna dictum porta. Vivamus suscipit tortor eget felis porttitor volutpat.',
    'Error: the requested operation could not be completed. Try again later or contact support.',
    'Page not available\n\nThe link you followed may be broken, or the page may have been removed.',
    'This feature needs JavaScript. Please enable it in your browser and reload this page.',
    'Name: ________\nDate: ________\nSignature: ________',
    'Your connection was interrupted. Please reload the page.',
    'You are not signed in. Please sign in to view this page.',
    'Project: <project name>\nOwner: TBD\nDeadline: TBD',
    'Dieser Inhalt ist derzeit nicht verfügbar. Bitte versuchen Sie es später noch einmal.',
    'Aktivieren Sie JavaScript in Ihrem Browser, um diese App zu verwenden.',
    'Lo sentimos, ha ocurrido un error. Vuelva a intentarlo más tarde.',
    'Désolé, une erreur interne est survenue sur le serveur.',
    'Service temporarily unavailable. The server is undergoing maintenance.',
    'Your text goes here. Replace this sample text.',
    'This application requires a browser with JavaScript enabled.',
    'Gateway error. The upstream server did not respond in time.',
    'The document you tried to open is missing or was deleted by its owner.',
    'Nothing to see here. This post has been removed.',
    'Server overloaded. Please come back later.',
    'You are offline. Check your connection and reload.',
    'Scripts must be allowed for this page to work.',
    'JavaScript seems to be disabled. Activate it in your browser settings to continue.',
    'Dear {{ first_name }},\n\nThank you for registering for {{ event }}. Your ticket number is {{ ticket }}.',
    'Subject: [Subject]\nTo: [Recipient]\nFrom: [Sender]',
    'Aenean lacinia bibendum nulla sed consectetur. Nullam quis risus eget urna mollis ornare vel eu leo.',
    'Hier entsteht demnächst Ihr Inhalt. Platzhaltertext.',
    'Die Verbindung zum Server wurde unterbrochen. Laden Sie die Seite neu.',
    'No se encontró el archivo solicitado.',
    "L'accès à cette page est interdit.",
    '403 - Forbidden: Access is denied.',
    'Request timed out. The server took too long to respond.',
    'Example text for layout purposes. Replace before publishing.',
    "JavaScript n'est pas activé. Activez-le puis rechargez la page.",
    'Session not found. It may have expired.',
    'Description: to be added\nReviewer: TBD\nRisk: TBD',
    'Please log in again. Your session timed out.',
]
#: Wordings that were written after all choices had been made.
LATER = [
    'The item you are trying to view was taken offline.',
    'We ran into a problem while loading this screen. Reload and try again.',
    '502 Bad Gateway\ncloudflare',
    'Your request was rejected by the security filter.',
    'This share link is no longer valid.',
    'Scripting has to be switched on for this viewer.',
    'This browser blocks JavaScript, therefore the page stays empty. Allow it and reload.',
    'Hi {first_name},\n\nyour subscription {plan} renews on {date}.\n\nYours,\n{company}',
    'Customer: [Customer]\nOrder: [Order No]\nTotal: [Total]',
    'Sed posuere consectetur est at lobortis. Donec ullamcorper nulla non metus auctor fringilla.',
    'Blindtext als Platzhalter, bitte später ersetzen.',
    'Der angeforderte Dienst ist zurzeit nicht erreichbar.',
    'El enlace ha caducado o no es válido.',
    'Cette page est introuvable ou a été supprimée.',
    '401 - Unauthorized: Access is denied due to invalid credentials.',
    'The server did not respond. Check the address or try later.',
    'Insert your own paragraph here. This is only an example.',
    'Il faut activer JavaScript pour afficher cette page.',
    'Chat not available. It may have been deleted.',
    'Cause: TBD\nFix: TBD\nVerified by: to be determined',
]
#: Real content that mentions or quotes residue.
MENTIONS = [
    "The renderer answers 404 Not Found when the slug has a trailing dot. I traced it to the router: it strips the dot before the lookup, so the cached entry never matches.",
    "We show 'Please enable JavaScript to view this page' in the fallback. The copy was agreed with design in March and the snapshot tests cover both themes.",
    "def greet(user):\n    return f'Hello {user.name}'\n\nThe helper is called from the mailer and from the digest job, which passes a tuple instead.",
    "Lorem ipsum is what our seed script writes into the body column, so the length histogram has a spike at 446 characters that has nothing to do with real posts.",
    "Status: done\nOwner: Mira\nSummary: the queue drains twice as fast since the batch size was raised to 64.",
    "Access was denied for the deploy key because its scope lacks packages:read; rotating it fixed the nightly build.",
]


def test_unseen_wordings_and_mentions(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs, labelled = spark.read.parquet(path), R.read_exemplars()
    index = R.Index(labelled, *R.weights(R.document_frequencies(docs, R.Index(labelled).keys), docs.count()))
    share = lambda texts: sum(R.coverage(t, index)[0] >= R.COVERAGE for t in texts) / len(texts)
    assert share(UNSEEN) >= 0.9 and share(LATER) >= 0.9
    assert share(MENTIONS) <= 1 / 6  # a short text of which a quoted notice is half is taken for one


def test_exemplars_as_a_table(spark):
    docs = spark.createDataFrame([(1, "zork blip"), (2, "zork blip frob"), (3, "the router is slow"), (4, None), (5, "")], "doc_id bigint, text string")
    own = spark.createDataFrame([("odd", "zork blip", 1), (None, "the router is slow", 1), ("odd", None, 1)], "kind string, text string, doc_id int")
    assert {(r.doc_id, r.kind) for r in R.residue(docs, own).collect()} >= {(1, "odd")} and 3 not in {r.doc_id for r in R.residue(docs, own).collect()}
    assert R.residue(docs, own.limit(0)).count() == 0
    assert R.document_frequencies(docs, ["zork", "router", "none"]) == {"zork": 2, "router": 1, "none": 0}


def test_large_lexicon_changes_nothing(spark):
    texts = pii_corpus() + ["the ticket was opened by Unheardof Vormoor today", "opened by brelda dramsen today", "opened by brelda unheardof today", "the ticket was opened by B. Unheard today", "then Kelsen, Brelda left, call (360) 555-0186"] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k bigint, text string, kind string")
    few, many = P.learn(df), P.learn(df, most=3)
    spans = [sorted((r.k, r.start, r.end, r["kind"]) for r in P.mentions(df, ["k"], x).collect()) for x in (few, many)]
    assert spans[0] == spans[1] and len(spans[0]) > 400
    assert [r for r in spans[0] if r[0] == len(pii_corpus()) and r[3] == "person"]
    assert sorted(map(str, P.redact(df, few, ["text"]).collect())) == sorted(map(str, P.redact(df, many, ["text"]).collect()))


def test_every_form_is_hinted():
    marker = P.Marker(set(), set(), set())
    for text in ("jo at mail (dot) example", "jo at mail [dot] example", "JO AT MAIL DOT EXAMPLE", "jo [At] mail.example", "jo {AT} mail.example", "jo (aT) mail (Dot) example"):
        assert [k for *_, k in marker.spans(f"write to {text} now")] == ["email"], text
    assert [k for *_, k in marker.spans("PaſſPort no. ZY5049387".replace("ſſ", "sſ"))] == ["id_number"]
    assert [k for *_, k in marker.spans("in Altes Ufer 12, 10115 Stadt")] == ["address"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["jo", "Mail", "x.example", " at ", " [At] ", "(AT)", "{at}", "@", "%40", " dot ", " (DOT) ", " [dot] ", "TIN", "tİn", " ", ": ", "12", "10115", "Altes ", "Ufer ", "Weg ", "Stadt", "rue ", ", "]), max_size=14).map("".join))
def test_every_match_is_hinted(text):
    low = P._lowered(text)
    assert not P.EMAIL.search(text) or P._hinted(P.EMAIL_HINTS, low) or " at " in low and "dot" in low
    assert not P.ID_LABELLED.search(text) or P._hinted(P.ID_HINTS, low)
    assert not P.ADDRESS.search(text) or P._hinted(P.ADDRESS_HINTS, text)


def test_split_keeps_a_run_that_fits_whole():
    for before, after in ((1700, 1700), (200, 3200), (3000, 400)):
        text = "a " * (before // 2) + "x" * 3600 + " b" * (after // 2)
        cuts = S.cut_points(text)
        assert all(text[c - 1].isspace() for c in cuts[1:-1]) and all(b - a <= 3800 for a, b in zip(cuts, cuts[1:]))
        assert cuts == sorted(set(cuts)) and cuts[-1] == len(text)
    assert len(S.split_text("ab " + "x" * 100_000, 400, 50)) < 600
