"""The small labelled table for text blocks: page pieces, each wholly main text or wholly not."""

from __future__ import annotations

from dataclasses import dataclass

_PROSE = ("The river rose in the night and by morning the lower meadow was under water, so the farmers moved the herd to the hill. "
          "Nobody had seen it so high since the old bridge was built, and the miller wrote the date on his wall.")
_LONG = f"{_PROSE} {_PROSE} {_PROSE}"
_SHORT = ("It was late.", "Then it rained for a week.", "Nobody answered.")
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Weather", "Local sports", "About us", "Contact"))
_MANY = "".join(f'<li><a href="/{k}">More on the year {1900 + k}</a></li>' for k in range(12))

# In an article: most is main text; lists of links, tag bars and what is named otherwise are not.
_INSIDE = [
    (f"<h1>A flood in the valley</h1><p>{_PROSE}</p>", True),
    (f"<p>{_SHORT[0]}</p><p>{_LONG}</p>", True),
    (f"<p><b>{_SHORT[1]}<br><p>{_PROSE}</p>", True),
    ("<h2>What came after</h2><ul><li>The bridge</li><li>The mill</li></ul>", True),
    (f'<p>{_PROSE} See <a href="/a">the flood maps</a> of the valley.</p><p>{_SHORT[2]}</p>', True),
    (f"<blockquote>{_SHORT[0]}</blockquote><table><tr><td>Height</td><td>4 m</td></tr></table>", True),
    (f"<header><h1>A flood in the valley</h1></header><p>{_PROSE}</p>", True),
    (f"<ul>{_MANY}</ul>", False),
    ('<p><a href="/">Home</a> / <a href="/n">News</a></p>', False),
    ('<div><a href="/t/1">floods</a> <a href="/t/2">rivers</a> <a href="/t/3">mills</a></div>', False),
    (f'<div class="ad">{_SHORT[1]} Buy boots now.</div>', False),
    (f'<aside><h3>Related</h3><p>{_PROSE}</p></aside>', False),
    (f'<div class="related-links"><ul>{_LINKS}</ul></div>', False),
    ('<form><label>Mail</label><input name="m"><button>Send</button></form>', False),
    (f'<footer><p>Filed under weather. {_SHORT[0]}</p></footer>', False),
    (f'<div class="share"><a href="/s">Share this</a></div>', False),
    (f'<section class="comments"><h2>3 comments</h2><p>{_LONG}</p><p>{_SHORT[2]}</p></section>', False),
]

# Around it.
_AROUND = [
    (f"<header><h1>The Valley Post</h1><p>{_SHORT[0]}</p></header>", False),
    (f"<nav><ul>{_LINKS}</ul></nav>", False),
    (f'<div class="ad">{_PROSE}</div>', False),
    (f'<div class="cookie-notice"><p>{_PROSE}</p><a href="/ok">Agree</a></div>', False),
    (f'<div id="sidebar"><h3>Most read</h3><ul>{_LINKS}</ul><p>{_PROSE}</p></div>', False),
    (f'<section class="comments"><h2>3 comments</h2><article><p>{_LONG}</p></article><p>{_SHORT[2]}</p></section>', False),
    (f'<div id="discussion"><p>{_LONG}</p><p>{_PROSE}</p></div>', False),
    (f'<form><p>{_PROSE}</p><label>Search</label></form>', False),
    (f"<footer>&copy; The Valley Post &middot; {_SHORT[0]} <p>{_PROSE}</p></footer>", False),
    (f"<ul>{_MANY}</ul>", False),
    (f"<div>{_SHORT[1]}</div>", False),
]

# On pages without an article element: length and links decide.
_TEXT = [
    f"<h1>A flood in the valley</h1><p>{_LONG}</p><p>{_PROSE}</p>",
    f"<div><p>{_LONG}</p><p>{_SHORT[0]}</p><p>{_LONG}</p></div>",
    f"<div>{_LONG}</div><p>{_SHORT[2]}</p>",
    f"<h2>Part two</h2><p>{_SHORT[1]}</p><p>{_PROSE}</p>",
    f"<p>{_SHORT[1]}</p><p>{_SHORT[0]}</p><p>{_SHORT[2]}</p><p>{_PROSE}</p>",
    f"<h1>Tall water</h1><p>{_SHORT[0]}</p><h2>Then</h2><ul><li>The bridge</li><li>The mill</li></ul>",
    f'<p>{_PROSE} See <a href="/a">the flood maps</a>.</p><p>{_SHORT[2]}</p>',
]
_NOT_TEXT = [
    f"<ul>{_LINKS}</ul>", f"<ul>{_MANY}</ul>", '<p><a href="/1">Older</a> <a href="/2">Newer</a></p>',
    "<div>All rights reserved.</div>", "<p>&copy; 2019 The Valley Post</p>", '<div><a href="/">Home</a> / <a href="/n">News</a></div>',
    f'<div class="ad">{_SHORT[1]} Buy boots now.</div>', f'<div id="commentlist"><p>{_LONG}</p><p>{_PROSE}</p></div>',
    f"<nav><ul>{_LINKS}</ul></nav>", f"<footer>&copy; The Valley Post {_SHORT[0]}</footer>",
]


@dataclass
class Labelled:
    pieces: list[tuple[str, bool]]
    before: str
    after: str

    @property
    def html(self) -> str:
        return self.before + "".join(p for p, _ in self.pieces) + self.after

    def labels(self, blocks) -> list[bool]:
        """One label per block: a piece alone gives as many blocks as in its page."""
        return [keep for piece, keep in self.pieces for _ in blocks(piece)]


def _wrapped(inside: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    first, last = inside[0], inside[-1]
    return [(f"<article>{first[0]}", first[1]), *inside[1:-1], (f"{last[0]}</article>", last[1])]


def pages() -> list[Labelled]:
    """Pages made from the pieces, in turn."""
    out = []
    head = "<!DOCTYPE html><html><head><style>p{}</style></head><body>"
    for k in range(40):
        inside = [_INSIDE[(k + j * (k % 5 + 1)) % len(_INSIDE)] for j in range(6)]
        around = [_AROUND[(k + j) % len(_AROUND)] for j in range(4)]
        out.append(Labelled([*around[:2], *_wrapped(inside), *around[2:]], head, "</body></html>"))
    for k in range(40):
        text = [(_TEXT[(k + j * (k % 3 + 1)) % len(_TEXT)], True) for j in range(3)]
        other = [(_NOT_TEXT[(k + j * (k % 4 + 1)) % len(_NOT_TEXT)], False) for j in range(4)]
        out.append(Labelled([other[0], text[0], other[1], text[1], text[2], *other[2:]], head, "</body></html>"))
    return out
