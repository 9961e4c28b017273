"""How often the keyed state is called: once for the messages of a batch, not once for each."""

from tracewright.streaming import state


class Store:
    """A state variable that counts its changes."""

    def __init__(self):
        self.kept, self.changes = [], 0

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept)

    iterator = get

    def put(self, rows):
        self.kept, self.changes = list(rows), self.changes + 1

    def appendValue(self, row):  # noqa: N802
        self.kept, self.changes = [*self.kept, row], self.changes + 1

    def updateValue(self, key, row):  # noqa: N802
        self.appendValue((key, row))

    def clear(self):
        self.kept, self.changes = [], self.changes + 1


class Value(Store):
    def get(self):
        return self.kept[0] if self.kept else None

    def update(self, row):
        self.put([row])


class Handle:
    getListState = getMapState = lambda self, *a: Store()  # noqa: E731, N815
    getValueState = lambda self, *a: Value()  # noqa: E731, N815


def test_a_batch_that_waits_is_one_change():
    told = state.Episodes("trace_id", 1, 1)
    told.init(Handle())
    m = lambda i: (i, "assistant", f"é {i}", None, i % 7 == 3, False, i % 5 == 0)
    rows = lambda came: [r for f in told._told((1,), came, False) for r in f.itertuples(index=False)]
    assert rows([m(i) for i in range(100, 50, -1)]) == [] and told.ahead.changes == 1
    assert rows([m(i) for i in range(101, 150)]) == [] and told.ahead.changes == 2
    assert rows([m(i) for i in range(0, 50)]) and told.ahead.changes == 2  # 50 is missing
    last = rows([m(50)])
    assert told.ahead.kept == [] and told.done.get()[0] == 150 and last[-1].combined.startswith("é ")
