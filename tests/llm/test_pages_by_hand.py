"""Pages written by hand, laid out otherwise than the training pages: how much of their main text is found."""

from collections import Counter

from trialworks.llm.html import main_text, trained

A = ["The council voted on Tuesday to reopen the old ferry line, which had been closed since the storm of last winter.", "Passengers will be able to cross twice an hour, and a monthly ticket is expected to cost about thirty pounds.", "Local shops welcomed the decision, although some residents fear that parking near the pier will become harder."]
B = ["Whisk the eggs with the sugar until the mixture is pale, then fold in the flour with a large metal spoon.", "Bake for forty minutes, or until a skewer comes out clean, and leave the cake in its tin for a quarter of an hour.", "It keeps for three days in a cool place, if nobody finds it first."]
C = ["In this release we rewrote the scheduler, which now starts jobs in the order of their deadlines.", "If you upgrade from an older version, please read the notes on configuration files, as two options have new names.", "Thanks to everyone who sent reports, tests and patches over the summer."]
D = ["Die Brücke wurde im Jahr 1894 eröffnet, und sie trägt bis heute den gesamten Verkehr zwischen den beiden Ufern.", "Nach der Sanierung, die fast drei Jahre dauerte, sind nun auch Radwege auf beiden Seiten vorhanden.", "Am Sonntag lädt die Stadt zu einem Fest ein, bei dem auch die alten Lampen wieder leuchten sollen."]


def p(xs):
    return "".join(f"<p>{x}</p>" for x in xs)


PAGES = [
    (f'<!doctype html><html lang=en><head><meta charset=utf-8><title>Ferry</title></head><body><div id=masthead><a href=/>The Pier Times</a><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></div><div class="lede-wrapper"><h1>Ferry line to reopen</h1>{p(A)}</div><div id=colophon>© 2024 The Pier Times. All rights reserved.</div></body></html>', ["Ferry line to reopen", *A]),
    (f'<html><body><nav><a href=1>Home</a> <a href=2>Recipes</a> <a href=3>Contact</a></nav><main><h2>Grandmother\'s cake</h2>{p(B[:2])}<aside><h4>You may also like</h4><a href=x>Plum tart</a><a href=y>Apple pie</a></aside>{p(B[2:])}</main><footer><p>Imprint | Privacy</p></footer></body></html>', ["Grandmother's cake", *B]),
    (f'<body><table width=100%><tr><td colspan=2><a href=/>Forge</a> | <a href=/dl>Downloads</a> | <a href=/docs>Docs</a></td></tr><tr><td valign=top><a href=a>1.0</a><br><a href=b>1.1</a></td><td><b>Version 2.0</b><br>{"<br><br>".join(C)}</td></tr></table></body>', ["Version 2.0", *C]),
    (f'<html><body><header role=banner><img src=logo.png alt=logo><form action=/suche><input name=q><button>Suchen</button></form></header><article itemscope><h1>130 Jahre Brücke</h1><div class=meta-line>Von A. Weber</div><section>{p(D)}</section></article><section class=discussion><h3>3 Kommentare</h3><div><b>Uli</b> Endlich!</div></section><footer>Impressum Datenschutz</footer></body></html>', ["130 Jahre Brücke", *D]),
    (f'<html><body><div class=cookie-layer>We use cookies to improve your visit. <button>Accept all</button></div><div class=page><div class=col-8><div class=txt><h1>Storm damage repaired</h1>{"".join(f"<div class=par>{x}</div>" for x in A)}</div></div><div class=col-4><div class=box><h5>Most read</h5><ol><li><a href=1>Harbour closed</a></li><li><a href=2>New mayor</a></li></ol></div></div></div></body></html>', ["Storm damage repaired", *A]),
    (f'<html><body><div><div><div><h1>Release notes</h1>{p(C)}<ul><li>faster start, by a third on most machines</li><li>less memory, since caches are shared now</li></ul></div></div></div><script>track("x")</script><div class=newsletter-signup><form>Subscribe to our newsletter <input type=email></form></div></body></html>', ["Release notes", *C, "faster start, by a third on most machines", "less memory, since caches are shared now"]),
    (f'<html><body><p class=crumbs><a href=/>Start</a> &gt; <a href=/k>Kuchen</a></p><h1>Kuchen</h1><blockquote>{B[0]}</blockquote>{p(B[1:])}<p class=share-row><a href=#>Share</a> <a href=#>Print</a></p></body></html>', ["Kuchen", *B]),
    (f'<html><body><main id=content><h1>Brücke</h1>{p(D[:1])}<div class=advertisement><p>Anzeige: jetzt 20 % sparen</p></div>{p(D[1:])}</main><div class=related><h4>Mehr zum Thema</h4><p><a href=1>Verkehr am Fluss</a></p></div></body></html>', ["Brücke", *D]),
]


def test_words_of_pages_written_by_hand():
    right = found = wanted = 0
    for page, blocks in PAGES:
        got, want = Counter(main_text(page, trained()).split()), Counter(" ".join(blocks).split())
        right, found, wanted = right + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
    print(f"recall {right / wanted:.3f}, precision {right / found:.3f}")
    assert right / wanted > 0.9 and right / found > 0.9
