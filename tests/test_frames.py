import pyarrow as pa

from hashgrove.functions import wire


def test_frames_of_many_bodies_go_in_few_batches(monkeypatch):
    line = lambda i: f"{len(str(i)) + 4:04x}{i}".encode()
    bodies = [(i, None if i % 7 == 0 else b"" if i % 7 == 1 else line(i) + b"0000" + line(-i) + (b"00zz" if i % 7 == 2 else b"0000")) for i in range(1000)]
    want = [(i, k, kind, text) for i, body in bodies if body for k, (kind, text) in enumerate([("line", str(i).encode()), ("flush", None), ("line", str(-i).encode()), ("malformed" if i % 7 == 2 else "flush", None)])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in bodies]), pa.array([b for _, b in bodies], pa.binary())], names=["id", "body"])

    def read():
        out = list(wire.read_frames(2)(iter([batch])))
        return out, [tuple(x.values()) for b in out for x in b.to_pylist()]

    out, rows = read()
    assert len(out) == 1 and rows == want
    monkeypatch.setattr(wire, "FRAME_ROWS", 9)
    out, rows = read()
    assert max(b.num_rows for b in out) == 9 and rows == want
    monkeypatch.setattr(wire, "FRAME_BYTES", 1)
    assert read()[1] == want
