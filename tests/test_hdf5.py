"""10x HDF5 files made byte by byte, read by several tasks."""

import struct
import zlib

import numpy as np
import pytest

from cohortlens import cli
from cohortlens.errors import DatasetError
from cohortlens.functions import hdf5
from cohortlens.sources import tenx_hdf5

UNDEFINED = (1 << 64) - 1


class Writer:
    """The first format generation: superblock 0, version 1 headers, symbol tables, chunk B-trees."""

    def __init__(self, user_block=0):
        self.out, self.base = bytearray(96), user_block

    def put(self, raw):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    def header(self, messages, continued=False):
        body = [struct.pack("<HHBxxx", k, len(b), 0) + b for k, b in ((k, b + b"\0" * (-len(b) % 8)) for k, b in messages)]
        if continued and len(body) > 1:  # all but the first message lie elsewhere
            rest = b"".join(body[1:])
            more = struct.pack("<HHBxxxQQ", 0x10, 16, 0, self.put(rest), len(rest))
            first = body[0] + more
            return self.put(struct.pack("<BxHIIxxxx", 1, len(body) + 1, 1, len(first)) + first)
        return self.put(struct.pack("<BxHIIxxxx", 1, len(body), 1, sum(map(len, body))) + b"".join(body))

    def group(self, children):
        names, offsets = bytearray(8), {}
        for n in sorted(children):
            offsets[n] = len(names)
            names += n.encode() + b"\0" * (8 - len(n) % 8)
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<BxxxQQQ", 0, len(names), 1, data))
        order = sorted(children)
        leaves = [order[i : i + 3] for i in range(0, len(order), 3)]  # several leaves, below a node
        nodes = [self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQIIQQ", offsets[n], children[n], 0, 0, 0, 0) for n in part)) for part in leaves]
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), UNDEFINED, UNDEFINED) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + struct.pack("<Q", 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def dataset(self, values, chunk=0, filters=(), continued=False, compact=False, text=False):
        if text:
            heap = bytearray()
            for i, v in enumerate(values):
                raw = v.encode()
                heap += struct.pack("<HHIQ", i + 1, 1, 0, len(raw)) + raw + b"\0" * (-len(raw) % 8)
            where = self.put(b"GCOL" + struct.pack("<BxxxQ", 1, len(heap) + 32) + bytes(heap) + bytes(16))
            raw, n, item = b"".join(struct.pack("<IQI", len(v.encode()), where, i + 1) for i, v in enumerate(values)), len(values), 16
            kind = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + bytes(8)
        else:
            values = np.asarray(values)
            raw, n, item = values.tobytes(), len(values), values.dtype.itemsize
            big = values.dtype.byteorder == ">"
            code = {"i": (0x10, 8 | big), "u": (0x10, int(big)), "f": (0x11, int(big)), "S": (0x13, 0)}[values.dtype.kind]
            kind = struct.pack("<BBBBI", code[0], code[1], 0, 0, item) + bytes(12)
        messages = [(0x01, struct.pack("<BBBxxxxxQ", 1, 1, 0, n)), (0x03, kind)]
        if chunk:
            packed = []
            for first in range(0, n, chunk):
                part = raw[first * item : (first + chunk) * item].ljust(chunk * item, b"\0")
                for f in filters:
                    if f == 2:
                        part = np.frombuffer(part, np.uint8).reshape(-1, item).T.tobytes()
                    elif f == 1:
                        part = zlib.compress(part)
                    else:
                        part += b"sum!"
                packed.append((first, len(part), self.put(part)))
            key = lambda first, size: struct.pack("<IIQQ", size, 0, first, 0)
            node = lambda level, rows: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(rows), UNDEFINED, UNDEFINED) + b"".join(k + struct.pack("<Q", c) for k, c in rows) + key(n, 0))
            leaves = [(key(packed[i][0], 0), node(0, [(key(f, s), a) for f, s, a in packed[i : i + 4]])) for i in range(0, len(packed), 4)]
            messages.append((0x08, struct.pack("<BBBQII", 3, 2, 2, node(1, leaves), chunk, item)))
            if filters:
                rows = b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", item if f == 2 else 6, 0) for f in filters)
                messages.append((0x0B, struct.pack("<BBxxxxxx", 1, len(filters)) + rows))
        elif compact:
            messages.append((0x08, struct.pack("<BBH", 3, 0, len(raw)) + raw))
        else:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw))))
        return self.header(messages, continued)

    def save(self, path, root):
        head = hdf5.MAGIC + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", self.base, UNDEFINED, len(self.out), UNDEFINED) + struct.pack("<QQIIQQ", 0, root, 0, 0, 0, 0)
        self.out[:96] = head
        path.write_bytes(bytes(self.base) + bytes(self.out))
        return str(path)


def matrix_file(path, dense, ids, kinds=None, barcodes=None, chunk=7, filters=(2, 1), leave_out=(), text=False, user_block=0, shape=None, dtype=np.int32):
    """A 10x file of a cells x features matrix."""
    w = Writer(user_block)
    rows, columns = np.nonzero(dense)
    pointers = np.concatenate([[0], np.cumsum((dense != 0).sum(1))]).astype(np.int64)
    barcodes = barcodes or [f"cell-{i}" for i in range(len(dense))]
    names = {"id": ids, "name": [x.upper() for x in ids], **({"feature_type": kinds} if kinds else {})}
    strings = (lambda v: w.dataset(v, text=True)) if text else (lambda v: w.dataset(np.array([x.encode() for x in v]), chunk=3, filters=(1,)))
    parts = {
        "data": w.dataset(dense[rows, columns].astype(dtype), chunk, filters), "indices": w.dataset(columns.astype(np.int64), chunk and chunk + 2, filters, continued=True),
        "indptr": w.dataset(pointers), "shape": w.dataset(np.array(shape or dense.shape[::-1], np.int32), compact=True), "barcodes": strings(barcodes), "features": w.group({k: strings(v) for k, v in names.items()}),
    }
    return w.save(path, w.group({"matrix": w.group({k: v for k, v in parts.items() if k not in leave_out})}))


def read_back(cohort, n_cells, ids):
    out = np.zeros((n_cells, len(ids)))
    place = {r.cell_id: r.cell_pos for r in cohort.cells.collect()}
    for r in cohort.expr.collect():
        out[place[r.cell_id], ids.index(r.gene_id)] = r.value
    return out


@pytest.mark.parametrize("chunk,filters,text,user_block,dtype", [(7, (2, 1), False, 0, np.int32), (7, (2, 1, 3), True, 512, np.int64), (0, (), False, 0, np.float32), (5, (), True, 0, ">i4")])
def test_values_come_back(spark, tmp_path, chunk, filters, text, user_block, dtype):
    rng = np.random.default_rng(1)
    dense = rng.poisson(0.6, (23, 9)).astype(float)
    dense[[0, 5, 22]] = 0  # empty cells, the first and last too
    ids = [f"g{i}" for i in range(9)]
    kinds = ["Antibody Capture" if i == 4 else "Gene Expression" for i in range(9)]
    path = matrix_file(tmp_path / "donor1.h5", dense, ids, kinds, chunk=chunk, filters=filters, text=text, user_block=user_block, dtype=dtype)
    cohort = tenx_hdf5.read_10x_hdf5(spark, path, elements=10)
    assert {r.sample_id for r in cohort.cells.collect()} == {"donor1"} and cohort.cells.count() == 23
    assert [(r.gene_id, r.gene_symbol) for r in cohort.genes.orderBy("gene_pos").collect()] == [(g, g.upper()) for g in ids if g != "g4"]
    dense[:, 4] = 0
    assert (read_back(cohort, 23, ids) == dense).all() and (read_back(cohort.matrix("counts"), 23, ids) == dense).all()


def test_several_tasks_read_one_file(spark, tmp_path):
    dense = np.arange(1, 201.0).reshape(20, 10)
    path = matrix_file(tmp_path / "x.h5", dense, [f"g{i}" for i in range(10)], chunk=16)
    spark.dataSource.register(tenx_hdf5.TenxHdf5)
    rows = spark.read.format("tenx_hdf5").options(path=path, elements=40).load()
    assert rows.rdd.getNumPartitions() == 5  # 48 values, three chunks, each
    assert sorted((r.cell_pos, r.feature, r.value) for r in rows.collect()) == [(i, j, dense[i, j]) for i in range(20) for j in range(10)]


def test_without_types_all_features_stay(spark, tmp_path):
    path = matrix_file(tmp_path / "x.h5", np.eye(3), ["a", "b", "c"])
    assert tenx_hdf5.read_10x_hdf5(spark, path, "s").genes.count() == 3


def test_command_line_tells_inputs_by_content(spark, tmp_path):
    path = matrix_file(tmp_path / "no-suffix", np.eye(3), ["a", "b", "c"])
    assert cli.read_cohort(spark, path).expr.count() == 3
    (tmp_path / "text.h5").write_text("not a matrix")
    with pytest.raises(DatasetError):
        cli.read_cohort(spark, str(tmp_path / "text.h5"))


def test_malformed_files_raise(spark, tmp_path):
    ids = ["a", "b", "c"]
    for i, options in enumerate([{"leave_out": ("indptr",)}, {"leave_out": ("features",)}, {"shape": (3, 4)}, {"kinds": ["Antibody Capture"] * 3}, {"barcodes": ["x", "x", "y"]}]):
        path = matrix_file(tmp_path / f"{i}.h5", np.eye(3), ids, **options)
        with pytest.raises(Exception, match="lacks|matrix is|has no|occurs twice"):
            tenx_hdf5.read_10x_hdf5(spark, path)
    with pytest.raises(Exception, match="occurs twice"):
        tenx_hdf5.read_10x_hdf5(spark, matrix_file(tmp_path / "d.h5", np.eye(3), ["a", "a", "b"]))
    w = Writer()
    with pytest.raises(Exception, match="no group /matrix"):
        tenx_hdf5.read_10x_hdf5(spark, w.save(tmp_path / "other.h5", w.group({"X": w.dataset(np.arange(3))})))
    whole = (tmp_path / "0.h5").read_bytes()
    (tmp_path / "cut.h5").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="cut short|can't be read|damaged|lacks|matrix"):
        tenx_hdf5.read_10x_hdf5(spark, str(tmp_path / "cut.h5"))
