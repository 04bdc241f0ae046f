"""Adapter views over the driver tables (FIXTURES.md §2).

Each adapter is SQL text in the subset Spark SQL and DuckDB share, so the
same definition feeds the Spark query and its oracle.
"""

from __future__ import annotations

# --- fixed values: link_pages insertions by page_id % 5 ---------------------
LINK_NAV = [
    '<a href="/x1">X</a><a href="/x1">X</a>',
    '<a href="https://partner.other.org/p">Partner</a>',
    '<a href="#">h</a><a href="">e</a><a href="javascript:void(0)">j</a><a>n</a>'
    '<div hidden>secret one</div><p style="display:none">gone two</p>',
    '<h2><a href="/inhead">In heading</a></h2><table><tr><th>A</th><th>B</th></tr>'
    '<tr><td><a href="/intable">T</a></td></tr></table><li>This list item is certainly long enough.</li>',
    '<a href="/login">Sign in</a><a href="../docs/a?x=1#f">Guide</a><a href="//cdn.example.com/z">Z</a>',
]
LINK_ARTICLE = ['<a href="/x1">X</a>', '<li>This list item is certainly long enough.</li>', '', '', '']
LINK_FOOTER = ['', '', '', '', '<a href="/imp">Imprint</a>']
# Relative references resolved against every page url.
HREF_FORMS = ["../docs/a?x=1#f", "//cdn.example.com/z", "?q=1", "#frag", "/abs/./b/../c",
              "rel/x", "HTTPS://Example.COM:443", "mailto:a@b.c", "", "./", "..", "/a b"]
# action_pages: button-like elements inserted after </nav> by page_id % 3.
ACTION_NAV = [
    '<button>Buy now</button><input type="submit" value="Send"><div role="button" aria-label="Open menu"></div>'
    '<button>Buy now</button>',
    '<input type="button" title="Help"><a role="button" href="/go">Go</a><button aria-label="Close"> </button>',
    '',
]
# frame_pages: iframes put after </article> by page_id % 5 (0: the page itself;
# 2: an empty page instead).
FRAME_CROSS = '<iframe src="https://frames.example.org/x"></iframe>'
FRAME_MISSING = '<p>before</p><iframe src="/not-captured"></iframe><p>after</p>'
# nested_pages: one site; after </article> a page of kind page_id % 6 shows the page
# so many ids further on: 0 -> 1 -> 3 -> 4 -> 3 (a cycle); kind 2 shows a page that
# is not there and one elsewhere, kind 5 nothing.
NESTED_SITE = 'https://site.example.org/p/'
NESTED_STEP = [1, 2, None, 1, -1, None]
# table_pages: a table put after </article> by page_id % 3.
NESTED_TABLES = [
    '<table class="pricing-table"><caption>Outer</caption><tr><td>A<table><caption>Inner</caption><tr><td>B</td></tr></table>C</td><td>D</td></tr></table>',
    '<table><tr><th>H</th></tr><tr><td> </td><td>x<table><tr><td>y<table><tr><td>z</td></tr></table></td></tr></table></td></tr></table>',
    '<h2 class="product-title">Boxes</h2><table><tr hidden><td>gone</td></tr><tr><td>kept</td></tr></table>',
]
EMPTY_PAGE = '<html><body> </body></html>'
# --- end fixed values -------------------------------------------------------


def _case(col: str, xs: list[str], mod: int) -> str:
    return "CASE " + " ".join(f"WHEN {col} % {mod} = {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"


def link_pages_html() -> str:
    """SQL expression (both engines) of the link_pages html column."""
    return (f"replace(replace(replace(html, '</nav>', concat('</nav>', {_case('page_id', LINK_NAV, 5)})), "
            f"'</article>', concat({_case('page_id', LINK_ARTICLE, 5)}, '</article>')), "
            f"'</footer>', concat({_case('page_id', LINK_FOOTER, 5)}, '</footer>'))")


def link_pages_sql(src: str = "pages") -> str:
    return f"SELECT page_id, url, {link_pages_html()} AS html FROM {src}"


def href_forms_values() -> str:
    return ", ".join(f"('{h}', {i})" for i, h in enumerate(HREF_FORMS))


def action_pages_html() -> str:
    return f"replace(html, '</nav>', concat('</nav>', {_case('page_id', ACTION_NAV, 3)}))"


def frame_pages_html() -> str:
    return (f"CASE page_id % 5 WHEN 2 THEN '{EMPTY_PAGE}' ELSE replace(html, '</article>', concat('</article>', CASE page_id % 5 "
            f"WHEN 0 THEN concat('<iframe src=\"', url, '\"></iframe>') WHEN 1 THEN '{FRAME_CROSS}' "
            f"WHEN 3 THEN '{FRAME_MISSING}' ELSE '' END)) END")


def table_pages_html() -> str:
    return f"replace({link_pages_html()}, '</article>', concat('</article>', {_case('page_id', NESTED_TABLES, 3)}))"


def nested_pages_select(text: str) -> str:
    """SQL select list of nested_pages (``text``: the engine's string type)."""
    def frame(step: int) -> str:
        # relative to the page that holds it, so that a nested one resolves differently against the root
        return f"concat('<h2>Before</h2><p>above</p><iframe src=\"', '../p/', CAST(page_id + ({step}) AS {text}), '\"></iframe><p>below</p>')"
    cases = " ".join(f"WHEN {i} THEN {frame(step)}" for i, step in enumerate(NESTED_STEP) if step is not None)
    return (f"page_id, concat('{NESTED_SITE}', CAST(page_id AS {text})) AS url, replace({table_pages_html()}, '</article>', "
            f"concat('</article>', CASE page_id % 6 {cases} WHEN 2 THEN '{FRAME_MISSING}{FRAME_CROSS}' ELSE '' END)) AS html")
