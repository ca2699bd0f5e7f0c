"""Pages written by hand, unlike those the field is trained on: what is kept of forms, headers, short and interrupted stories."""

import pytest

from motecraft.llm import html_crf

LONG = "The council met on Tuesday to discuss the new bridge over the river, and after three hours of debate it agreed to wait for the engineers' report. " * 3
SHORT = "Heavy rain closed two roads near the harbour on Monday morning."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
FOOT = "<footer>© 2021 Example Media. All rights reserved.</footer>"
FORM = "<form><p>Subscribe to our newsletter</p><input name=mail><button>Go</button></form>"


def text(*parts: str) -> str:
    return "\n\n".join(" ".join(p.split()) for p in parts)


CASES = {
    "form_in_article": (f"<article><h1>Bridge plan waits</h1><p>{LONG}</p>{FORM}</article>", ("Bridge plan waits", LONG)),
    "form_between": (f"{MENU}<article><h1>Bridge plan waits</h1><p>{LONG}</p>{FORM}<p>{SHORT}</p></article>{FOOT}", ("Bridge plan waits", LONG, SHORT)),
    "form_on_top": (f"<form><p>Search this site for news</p><input name=q></form><article><h1>Storm</h1><p>{SHORT}</p><p>{LONG}</p></article>", ("Storm", SHORT, LONG)),
    "site_header": (f"<header><h1>My Site</h1><p>Tagline</p></header><article><h1>Storm</h1><p>{SHORT}</p><p>{LONG}</p></article>", ("Storm", SHORT, LONG)),
    "header_and_menu": (f"<header><h1>My Site</h1><p>News for the coast</p>{MENU}</header><main><p>{LONG}</p></main>{FOOT}", (LONG,)),
    "one_paragraph": (f"<article><p>{LONG}</p></article>", (LONG,)),
    "one_short_paragraph": (f"<article><p>{SHORT}</p></article>", (SHORT,)),
    "one_paragraph_in_main": (f"<html><body>{MENU}<main><p>{LONG}</p></main>{FOOT}</body></html>", (LONG,)),
    "bare_article": (f"<article>{LONG}</article>", (LONG,)),
    "bare_main": (f"{MENU}<main>{SHORT}</main>", (SHORT,)),
    "lines": (f"<article>{SHORT}<br>{LONG}<br><br>{SHORT}</article>", (f"{SHORT} {LONG} {SHORT}",)),
    "one_division": (f"<article><div>{LONG}</div></article>", (LONG,)),
    "one_division_with_a_menu": (f"{MENU}<article><div>{LONG}</div></article>{FOOT}", (LONG,)),
    "named_division": (f'{MENU}<div class="story"><div>{LONG}</div></div>{FOOT}', (LONG,)),
    "select": (f"<article><p>{LONG}</p><select><option>One</option><option>Two</option></select></article>", (LONG,)),
    "only_a_paragraph": (f"<p>{LONG}", (LONG,)),
    "only_paragraphs": (f"<html><body><p>{LONG}</p><p>{SHORT}</p></body></html>", (LONG, SHORT)),
    "interrupted": (f'<article><h1>The council</h1>{MENU}<p>{SHORT}</p><aside><h3>Related</h3><ul><li><a href="/a">Other</a></li></ul></aside><p>It then rose.</p></article>', ("The council", SHORT, "It then rose.")),
    "titled_by_a_header": (f"<header><p>My Site</p></header><article><header><h1>Storm hits the coast</h1></header><p>{SHORT}</p><p>{LONG}</p></article>", ("Storm hits the coast", SHORT, LONG)),
    "comments": (f'<article><h1>Storm</h1><p>{LONG}</p></article><section class="comments"><p>Nice report, thank you for writing it.</p></section>{FOOT}', ("Storm", LONG)),
    "page_in_a_form": (f'<form id="aspnet">{MENU}<article><h1>Storm hits the coast</h1><p>{LONG}</p><p>{SHORT}</p></article>{FOOT}</form>', ("Storm hits the coast", LONG, SHORT)),
    "menus_only": (f"{MENU}{FOOT}", ()),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text_of(name):
    page, kept = CASES[name]
    assert html_crf.default_field().extract(page) == text(*kept)
