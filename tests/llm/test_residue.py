"""Template residue, filler, error pages, script notices."""

import pytest

from claimlake.llm import residue as R

CASES = [
    "# {{ project_name }}\n\nRun {{install_command}} first.", "Dear ${NAME}, welcome.", "This belongs to $LICENSE$.", "By @@AUTHOR@@ since 2020.", "See [[REPO_URL]] now.", "Release #{version} is out.", "Welcome to __PROJECT_NAME__.",
    "| a | [YOUR COMPANY] |", "Write to [your email here].", "Only <INSERT YOUR RELEASE DATE> is supported.", "<<YOUR TITLE>> ships.", "At {CONTACT} we help.", "<%= title %> is ready.", "{% company %} made this.",
    "# Guide\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed.", "asdf xxx test test foo bar baz", "blah blah blah, describe the feature, blah blah", "Sample text sample text sample text.", "Content coming soon.",
    "This is placeholder copy. Do not publish.", "Insert description here.", "Text text text. More text. Even more text text.", "Add a short summary of the project here (two or three lines).", "Your text goes here. Replace this paragraph with real content.",
    "404 Not Found\n\nThe page you requested could not be found.", "Menu  Search\n\n# Oops\n\n访问被拒绝。请登录后重试。", "HTTP Status 503 – Service Unavailable", "Error: bad gateway while fetching /x/y. Retry.", "We're sorry. you have been rate limited (code: 429).",
    "<html><head><title>403 Forbidden</title></head><body><h1>Forbidden</h1></body></html>", "404 - Página no encontrada.", "Der Dienst ist vorübergehend nicht verfügbar.", "\ufeffSomething went wrong.\n\nRequest id a-1.",
    "You need to enable JavaScript to run this app.", "<noscript>Active JavaScript en su navegador para ver esta página.</noscript>", "# Title\n\nScripts are blocked. The viewer cannot be shown.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "请启用 JavaScript 以查看此页面。",
]
CLEAN = [
    "Templates use the `{{ title }}` form; quote it as shown:\n\n```\n# {{ project_name }}\n${AUTHOR}\n```", "The route GET /a/{id}/b returns 404 Not Found when it is old.", 'To change the error page, edit `404.html`; its heading reads "Page not found" until you replace it.',
    'If the gateway answers "502 Bad Gateway", wait.', 'Readers who disable JavaScript still get it, because the page says "Please enable JavaScript".', "The screenshots use lorem ipsum as sample copy, which is on purpose.",
    "A placeholder such as [YOUR NAME] left in a README is reported.", "Set it first. [YOUR NAME] left in a README is reported as a finding.", "Use %s for strings and %d for numbers.", "Keep [optional] arguments last.", "Translations live next to the source as {stem}-zh.md, and $HOME/.config holds more.", "| `x` | 500 |\n| `y` | 404 |",
    "See [CHANGELOG](x.md) and [API][ref].", "El mensaje de error crece hasta 404 entradas.", "", "   ", "Set it to 500 if the page must stay.",
]


def hit(text):
    e = R.examine(text)
    return e["placeholders"] + e["filler"] + e["messages"] > 0


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert hit(text)
    assert hit("# Real title\n\nReal words about the tool and how it is used.\n\n" + text + "\n\nMore real words.")


@pytest.mark.parametrize("text", CLEAN)
def test_no_cases(text):
    assert not hit(text)


RARE = [
    "400 Bad Request", "405 Method Not Allowed", "402 Payment Required", "413 Payload Too Large", "409 Conflict", "You must log in to continue.", "Please sign in to view.", "You are not authorized", "You are not allowed", "We are currently down.",
    "To be written.", "To be completed.", "Replace this paragraph with your own words.", "Rewrite this section.", "Die Seite existiert nicht.", "x1 x2 x3 x4 xx5 xxx6", "Dear {  NAME  }, welcome.", "See [1 link here] first.", "{\u200b{ title }} is ready.",
]


@pytest.mark.parametrize("text", RARE)
def test_no_text_is_left_unread(text):
    assert hit(text)


def test_pages_without_a_listed_word_are_read():
    assert R.examine("Request 8: retry, then sign in.")["words"] == 5 and R.examine("Step 4 needs 431 of them.")["words"] == 4


def frame(spark, *rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, path string, key string, filler int")


def test_duplicated_responses(spark):
    odd = "Session 1{} could not continue: sign in, then retry at {}."
    rows = [(n, odd.format(n, n * 7), f"site{n % 3}", f"guides/page-{n}.md", "k", 1) for n in range(6)] + [(50, "Plain words about retry and sign in.", "s", "guides/words.md", None, None)]
    assert sorted(r.doc_id for r in R.residue_evidence(frame(spark, *rows)).where("reason = 'response'").collect()) == list(range(6))


def test_nulls_repeats_long_and_empty(spark):
    long_text = "word " * 300_000 + "\n\nLorem ipsum dolor sit amet consectetur."
    f = frame(spark, (1, None, None, None, None, None), (None, CASES[0], None, None, None, None), (2, CASES[0], None, None, None, None), (2, CASES[0], None, None, None, None), (3, long_text, None, None, None, None), (4, CLEAN[0], None, None, None, None))
    assert sorted(r.doc_id for r in R.residue_evidence(f).collect()) == [2, 3]
    assert R.residue_evidence(f.limit(0)).isEmpty()


PLAIN = [
    "Contact {{ .Site.Title }} now.", 'By {{ user["name"] }}.', "Dear <Name>, thanks.", "<Error><Code>AccessDenied</Code><Message>Access Denied</Message></Error>", "Just a moment...", "Page introuvable.", "Página não encontrada.", "ページが見つかりません。",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.", "<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center><hr><center>nginx</center></body></html>", "Veuillez activer JavaScript pour continuer.",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_cases(text):
    assert hit(text)


#: Responses in languages that no list knows, and short documents with copies under other addresses.
UNLISTED = [
    "Sivua ei löytynyt", "Nie można odnaleźć strony", "Sidan kunde inte hittas", "Palvelu on poissa käytöstä", "Dostęp zabroniony dla tego adresu", "Tjänsten är inte tillgänglig just nu",
    "Ota JavaScript käyttöön jatkaaksesi", "Włącz obsługę skryptów, aby kontynuować", "Slå på skript för att fortsätta", "Palvelin ei vastannut ajoissa", "Serwer nie odpowiada", "Servern svarade inte",
]


def test_unlisted_languages_by_company(spark):
    assert not any(hit(t) for t in UNLISTED)
    furniture = ["", "\n\nEtusivu", "\n\nHjälp och stöd", "\n\nMenu główne"]
    rows = [(n * 20 + k, f"# {t}\n\n{t}.{furniture[(n + k) % 4]}", f"site{k % 5}", f"guides/topic-{k}.md") for n, t in enumerate(UNLISTED) for k in range(8)]
    own = ["Every importer keeps its journal until the nightly run has ended.", "Ledgers are compared by date first and by owner afterwards."]
    rows += [(1000 + n * 20 + k, own[n] + f" Copy {k}.", f"site{k}", f"guides/other-{k}.md") for n in range(2) for k in range(4)]
    f = spark.createDataFrame(rows, "doc_id bigint, text string, source string, path string")
    got = {r.doc_id: r.residue for r in R.response_scores(f).collect()}
    responses = [r[0] for r in rows if r[0] < 1000]
    assert sum(got[i] for i in responses) > 0.9 * len(responses) and not any(got[i] for i in got if i >= 1000)
    assert len(got) == len(rows)
    assert {r.doc_id for r in R.residue_evidence(f).collect()} == {i for i in got if got[i]}


def test_terms_are_compared():
    e = R.examine("# Not found\n\nThe page is gone.", "guides/queue-7.md")
    assert (e["slug_title"], e["slug_body"], e["title_body"]) == (-1, -1, -1)
    e = R.examine("# The queue\n\nA queue holds work.", "guides/queue-7.md")
    assert (e["slug_title"], e["slug_body"], e["title_body"]) == (1, -1, -1)
    assert R.examine("Plain text.", None)["slug_body"] == 0
