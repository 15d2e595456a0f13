from pressweave.functions import text as tx

# One pair per kind of character: accents, letters without a base letter, quotes, ligatures and fractions, signs, other
# scripts, digraphs and numerals, blanks, joiners.
NORMS = {"Ünïcödé ÀÉÎõ": "unicode aeio", "Ødegaard": "degaard", "d’or": "dor", "d'or": "d or", "ﬁne ½ №5": "fine 12 no5",
         "a…b™": "a btm", "İstanbul ı": "istanbul", "كرة القدم": "", "ǅ Ⅻ": "dz xii", " x \u00a0 y\tz\n": "x y z", "a_b-c": "a_b c",
         "": "", None: "", "Already plain": "already plain", "100 %, (ok)!": "100 ok"}
KEYS = {"Ünïcödé ÀÉÎõ": "unicode_aeio", "Ødegaard": "degaard", "d’or": "d_or", "d'or": "d_or", "ﬁne ½ №5": "ne_5", "a…b™": "a_b",
        "İstanbul ı": "istanbul", "كرة": "", "ǅ Ⅻ": "", " x \u00a0 y\tz\n": "x_y_z", "a_b-c": "a_b_c", "__a__": "a", "": "", None: ""}


def test_norm_text(values):
    assert values(tx.norm_text, list(NORMS)) == list(NORMS.values())
    assert [tx.norm_words(s or "") for s in NORMS] == list(NORMS.values())


def test_norm_text_of_a_norm_is_itself(values):
    assert values(tx.norm_text, list(NORMS.values())) == list(NORMS.values())


def test_key_text(values):
    assert values(tx.key_text, list(KEYS)) == list(KEYS.values())


def test_clean_value(values):
    assert values(tx.clean_value, [" NaN ", None, "None", "\tx y ", "nat", "nation"]) == ["", "", "", "x y", "", "nation"]


def test_polish_text(values):
    assert values(tx.polish_text, ["a,b;c", "motCle", "12x3", "x  y ", "nan", "étéÀ"]) == ["a, b; c", "mot Cle", "12 x 3", "x y", "", "été À"]


def test_shorten(values):
    assert values(lambda c: tx.shorten(c, 5), ["abcde", "abcdef", "abc  def"]) == ["abcde", "abcd…", "abc…"]
    assert values(lambda c: tx.shorten_clean(c, 5), [" a  b ", "nan"]) == ["a b", ""]


def test_clean_html(values):
    got = values(tx.clean_html, ["<p>a &amp; b</p><script>x</script> &eacute;&#233;&#xE9; &amp;lt; &unknown; <!-- c -->z", None, "a&nbsp;&#160; b"])
    assert got == ["a & b ééé &lt; &unknown; z", "", "a b"]


def test_tokens_and_language(values):
    assert sorted(values(tx.tokenize, ["The Football coupe à Été ab abc abc"])[0]) == ["abc", "été"]
    assert values(tx.detect_language, ["", "   ", "نادي club", "voici le match", "a b c d e le", "hello"]) == ["fr", "fr", "ar", "fr", "en", "en"]


def test_biography_organisation(values):
    texts = ["He plays as a forward for Serie A club Napoli and Italy.", "She plays for the Ajax, a club", "none"]
    assert values(tx.current_org, texts) == ["Napoli", "Ajax", ""]

