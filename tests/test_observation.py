"""Observation of a hand-written form page and of many nodes."""

from conftest import pages_df

from pagefold.operators import observation as N

BOOKING = """<body><p><a id=terms href="terms.html">Terms</a></p>
<form id=book action="reserve"><label for=who>Your name</label><input id=who name=who value="Ada L.">
<textarea id=note></textarea><input type=radio id=am name=t><input type=radio id=pm name=t checked>
<select id=size size=4><option>S</option></select><select id=day><option value="">any</option><option selected>Tue</option></select>
<button id=send disabled>Reserve</button></form>
<ul><li id=tip role=option tabindex=0>Bring a lock</li></ul>
<iframe id=map src="map.html"></iframe></body>"""
AT = "https://velo.example/booking/"


def test_booking_form(spark):
    p = pages_df(spark, [(1, AT, BOOKING)])
    nodes = {r.selector_hint: r for r in N.observation_nodes(p).collect()}
    who, send = nodes["#who"], nodes["#send"]
    assert (who.role, who.name, who.value_redacted) == ("textbox", "Your name", True)
    assert (send.role, send.name, send.enabled, send.selector_hint_unique) == ("button", "Reserve", False, True)
    assert (nodes["#am"].checked, nodes["#pm"].checked) == (False, True)
    assert [nodes[k].role for k in ("#size", "#day")] == ["listbox", "combobox"]
    assert nodes["#terms"].href == AT + "terms.html"
    assert nodes["#note"].value_redacted is not True
    forms = N.observation_forms(p).collect()
    assert (forms[0].ref, forms[0].action) == ("form-0", AT + "reserve")
    assert forms[0].field_refs == [nodes[k].ref for k in ("#who", "#note", "#am", "#pm", "#size", "#day", "#send")]
    frames = sorted((r.frame_id, r.url) for r in N.observation_frames(p).collect())
    assert frames == [("iframe-0", AT + "map.html"), ("main", AT)]


def test_node_cap_and_empty(spark):
    html = "<body>" + "".join(f"<p><button name=b{i}>Row {i}</button></p>" for i in range(130)) + "</body>"
    p = pages_df(spark, [(1, "http://h/", html), (2, "http://h/e", "<body></body>")])
    assert N.observation_nodes(p).where("page_id = 1").count() == 130
    assert N.observation_nodes(p, N.NODE_LIMIT, N.SCAN_LIMIT).where("page_id = 1").count() == 100
    t = N.observation_truncated(p, N.NODE_LIMIT, N.SCAN_LIMIT).collect()
    assert [(r.page_id, r.reason, r.emitted_nodes) for r in t] == [(1, "node_limit_exceeded", 100)]
    empty = N.observation_empty(p, N.observation_nodes(p)).collect()
    assert [r.page_id for r in empty] == [2]
    audit = N.label_audit(N.observation_nodes(p)).count()
    assert audit == 0


def test_names_are_cut_only_on_request(spark):
    long = "word " * 40 + "captcha"
    html = f'<body><label for=f>{long}</label><input id=f><button id=b>{long}</button><a id=l href="/" aria-label="{long}">x</a></body>'
    p = pages_df(spark, [(1, "http://h/", html)])
    whole = {r.selector_hint: r for r in N.observation_nodes(p).collect()}
    assert {k: whole[k].name for k in ("#f", "#b", "#l")} == dict.fromkeys(("#f", "#b", "#l"), long) and whole["#b"].text == long
    assert N.label_audit(N.observation_nodes(p)).count() == 3
    cut = N.observation_nodes(p, name_cut=N.NAME_CUT)
    assert {r.name for r in cut.collect()} == {long[:160]}
    assert N.label_audit(cut).count() == 0
