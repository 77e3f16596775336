import base64
import quopri

from keystrata.llm import mailtext as m


def words(raw):
    return [m.part_words(p) for p in m.parts(raw)]


def test_encodings():
    text = "Grüße aus Köln, naïve façade"
    b64 = base64.encodebytes(text.encode()).decode()
    qp = quopri.encodestring(text.encode()).decode()
    head = "content-type: text/plain;\n charset=utf-8\ncontent-transfer-encoding: "
    want = [["grüsse", "aus", "köln", "naïve", "façade"]]
    for enc, body in (("BASE64", b64), ("Quoted-Printable", qp), ("8bit", text)):
        for nl in ("\n", "\r\n"):
            assert words(f"{head}{enc}\n\n{body}".replace("\n", nl)) == want
    assert words("Content-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: base64\n\n" + b64) == want
    assert words("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + b64.strip()[:-3])[0][:3] == want[0][:3]


def test_multiparts():
    raw = (
        'Subject: s\nContent-Type: multipart/mixed;\n boundary="B 1"\n\npreamble\n--B 1\nContent-Type: multipart/alternative; boundary=b2\n\n--b2\n\nplain words\n--b2\n'
        "Content-Type: text/html\n\n<p>html<b>ly</b> words<br>more</p><style>no</style>\n--b2--\n--B 1\nContent-Type: application/octet-stream\nContent-Disposition: attachment\n\nAAAA\n"
        '--B 1\nContent-Type: text/plain; name="l.txt"\n\nlisted'
    )  # the end boundary is missing
    p = m.parts(raw)
    assert [(x.is_html, x.is_attachment) for x in p] == [(False, False), (True, False), (False, True)]
    assert words(raw) == [["plain", "words"], ["htmlly", "words", "more"], ["listed"]]


def test_parts_at_any_depth():
    b64 = base64.b64encode(b"deep words").decode()
    for levels in (19, 20, 21, 60, 2000):
        mail = f"Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n{b64}\n"
        for i in range(levels):
            if i % 3 == 2:
                mail = "Content-Type: message/rfc822\n\n" + mail
            else:
                after = "--b%d\n\nafter\n" % i if i == 0 else ""
                mail = f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n{mail}\n{after.replace('b0', 'b0x')}--b{i}x--\n"
        assert words(mail) == [["deep", "words"], ["after"]]


def test_html_and_odd_input():
    html = "Content-Type: text/html\n\n<p>s&#112;am &amp; &uuml;ber<span class='x'>all</span></p><td>a</td><td>b</td><a href=\"http://x.example/y?id=3\">go</a><blockquote>old <blockquote>older</blockquote> old</blockquote>new"
    assert words(html) == [["spam", "überall", "a", "b", "go", "old", "older", "old", "new"]]
    own = " ".join(m.own_lines(html)[0]).split()
    assert "http://x.example/y?id=3" in own and "new" in own and "old" not in own and "older" not in own
    assert m.parts(None) == [] and m.parts("") == [] and words("no headers here\n\nbody") == [["body"]]
    assert words("Content-Type: multipart/mixed\n\nwithout boundary") == [["without", "boundary"]]
    assert words("\nbody only") == [["body", "only"]]
    assert words("A: b\n\nso­ft hy​phen été") == [["soft", "hyphen", "été"]]
    nested = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(60)) + "\nend"
    m.parts(nested)
    assert words("A: b\n\n" + "word " * 200_000)[0] == ["word"] * 200_000


def test_quotations():
    raw = "A: b\n\nmine\n> theirs\n| theirs\n\nOn Mon, 3 Mar 2031 16:06:36 -0500, N G wrote:\n\n    quoted block\n    goes on\n\n    still\nmine again"
    assert [x for x in m.own_lines(raw)[0] if x] == ["mine", "mine again"]
