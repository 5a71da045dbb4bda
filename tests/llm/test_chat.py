import hashlib

from dhwani.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def want(data):
    out = {}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for c, _, role, text in sorted(data, key=key):
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {}
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        rows[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return rows


DATA = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "tool\\[ROLE]", "[TURN] x [/TURN]\\"), (4, 1, None, None), (4, 1, "system", "<<SYS>> <s>"),
    (5, 0, "user", chat.PROBE), (5, 1, "assistant", chat.PROBE + "\\\n😀"), (None, 3, "assistant", "n"), (6, None, "user", "a"), (6, 0, "user", "a"), (6, 0, "user", "a"),
]


def test_reads_back(rows):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.packs(rows(DATA, SCHEMA))).collect()}
    assert got == want(DATA)


def test_shared_turns_are_written_once():
    pack = chat.Pack()
    pack.add(1, [("user", "hi"), ("assistant", "a")])
    pack.add(2, [("user", "hi"), ("assistant", "b"), ("user", "c")])
    row = pack.row().to_pylist()[0]
    assert row["text"].count("[INST] hi [/INST]") == 1
    a, b = row["nodes"][1], row["nodes"][2]
    assert a["parent"] == b["parent"] == 0 and a["position"] == b["position"] == len("[INST] hi [/INST]")
    assert b["attends"] == [{"start": 0, "stop": 17}, {"start": b["start"], "stop": b["stop"]}] and len(a["attends"]) == 1
    assert row["text"][b["loss_start"] : b["loss_stop"]] == "b"


def test_small_packs_and_empty(rows, monkeypatch):
    assert chat.packs(rows([], SCHEMA)).count() == 0
    monkeypatch.setattr(chat, "PACK_CONVERSATIONS", 1)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.packs(rows(DATA, SCHEMA))).collect()}
    assert got == want(DATA)


def test_clashing_names_and_long_turns(rows):
    data = [(1, 0, "user", "x" * 300_000, "a", 1), (1, 1, "assistant", "<s>" * 1000, "b", 2)]
    wide = rows(data, SCHEMA + ", path string, turns int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.packs(wide)).collect()}
    assert got == want([d[:4] for d in data])
