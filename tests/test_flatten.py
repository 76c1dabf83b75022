"""Records that are deep, damaged or oddly encoded cost neither the run nor their neighbours."""

from vigilake.functions import flatten as fl


def test_json_order_and_lists():
    pairs = fl.json_record('{"a":{"b":[1,{"c":"x"}],"e":{}},"d":null,"a2":[]}')
    assert pairs == [("a.b[0]", 1), ("a.b[1].c", "x"), ("d", None)]
    assert fl.json_record("[1]") is None and fl.json_record("{") is None and fl.json_record(None) is None


def test_surrogates_and_depth():
    rows = fl.to_arrow([fl.json_record('{"a":"\\ud800x"}'), fl.json_record('{"a":' * 300_000), fl.json_record('{"ok":1}')]).to_pylist()
    assert rows[0] == [{"key": "a", "name": "a", "value": "?x"}] and rows[2][0]["value"] == "1"
    value = "x"
    for _ in range(5000):
        value = [value]
    assert fl.unfold("k", value, fl.json_members) == [("k" + "[0]" * 5000, "x")]
    deep = "<r>" + "<a>" * 3000 + "v" + "</a>" * 3000 + "</r>"
    assert fl.xml_record(deep) == [(".".join("a" for _ in range(3000)), "v")]


def test_xml_records():
    assert fl.xml_record('<r id="1"><b x="2">t</b><c>1</c><b/>tail<c>2</c></r>') == [
        ("@id", "1"), ("b[0].@x", "2"), ("b[0].#text", "t"), ("b[1]", ""), ("c[0]", "1"), ("c[1]", "2")]
    event = '<e:Event xmlns:e="u"><e:System><EventID>4625</EventID></e:System><EventData><Data Name="IpAddress"> 1.2.3.4 </Data><Data>n</Data></EventData></e:Event>'
    assert fl.xml_record(event) == [("System.EventID", "4625"), ("IpAddress", "1.2.3.4")]
    assert fl.xml_record("<r>") is None


def test_documents_give_their_own_record_texts():
    assert fl.record_texts('<p:log xmlns:p="u"><p:row a="&gt;">1</p:row><head/><p:row/></p:log>') == ['<p:row a="&gt;">1</p:row>', "<p:row/>"]
    assert fl.record_texts("<a>1</a><a>2</a><b/>") == ["<a>1</a>", "<a>2</a>"]
    assert fl.record_texts("<Event><x/></Event>") == ["<Event><x/></Event>"]
    assert fl.record_texts("<a>") is None and fl.record_texts("<a/>") == []
