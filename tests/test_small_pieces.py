"""Small pieces share tasks and read little more than themselves."""

from wattledger.sources import tail


def test_small_pieces_share_tasks(folder):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(40_000)]
    with open(f"{folder}/c.s.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    reader, taken = tail.SpoolTailReader(folder, 256), []

    class Counted:
        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            taken.append(n)
            return self.f.read(n)

    end = reader.latestOffset()
    tasks = reader.partitions({}, end)
    assert len(tasks) == 1 and len(tasks[0].pieces) == -(-end["c.s.jsonl"] // 256)
    assert [r[6] for r in reader.read(tasks[0])] == lines
    with open(f"{folder}/c.s.jsonl", "rb") as f:
        list(reader._read_piece(Counted(f), tasks[0].pieces[7]))
    assert sum(taken) <= 2 * tail.LEAST_READ
