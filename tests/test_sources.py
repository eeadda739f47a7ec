"""Readers on small files of each format's shape."""

import gzip
import io
import tarfile
import zipfile

import numpy as np
import pytest

from strandlake.sources import datasets as D
from strandlake.sources import embeddings as E
from strandlake.sources import text as S


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{path}"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">s1 A->G variant\nMKV\nLA\n\n>s2>x\r\nG G\r\n")
    assert rows(S.read_fasta(spark, path), "id", "description", "sequence") == [("s1", "s1 A->G variant", "MKVLA"), ("s2>x", "s2>x", "GG")]
    zipped = put(tmp_path, "b.fasta.gz", gzip.compress(b">z\nAC\n"))
    assert rows(S.read_fasta(spark, zipped), "id", "sequence") == [("z", "AC")]


def test_intervals(spark, tmp_path):
    path = put(tmp_path, "i.tsv", "id\tsequence\tstart\tend\tsplit\na\tMKVLA\t2\t3\ttest\na\tMKVLA\t5\t\ttest\nb\tMK\t1\t2\t\n")
    assert rows(D.read_intervals(spark, path), "id", "labels", "split") == [("a", [0, 1, 1, 0, 1], "test"), ("b", [1, 1], "train")]
    for bad in ("a\tMK\t0\t1\t", "a\tMK\t2\t3\t", "a\tMK\t2\t1\t", "a\tMK\t1\t1\t\na\tMKV\t1\t1\t", "\tMK\t1\t1\t"):
        with pytest.raises(Exception, match="position|sequence"):
            D.read_intervals(spark, put(tmp_path, "bad.tsv", "id\tsequence\tstart\tend\tsplit\n" + bad + "\n")).collect()


def test_residue_table(spark, tmp_path):
    path = put(tmp_path, "r.csv", 'id,sequence,labels,split,mask\na,MKV,"[1,0,1]",test,"1,0,1"\nb,MK,01,,11\nc,MKV,0 1 1,val,true false true\n')
    assert rows(D.read_residue_table(spark, path), "id", "labels", "mask", "split") == [("a", ["1", "0", "1"], [True, False, True], "test"), ("b", ["0", "1"], [True, True], "train"), ("c", ["0", "1", "1"], [True, False, True], "val")]
    with pytest.raises(Exception, match="another length"):
        D.read_residue_table(spark, put(tmp_path, "s.csv", "id,sequence,labels\na,MKV,01\n")).collect()


def test_flip(spark, tmp_path):
    path = put(tmp_path, "f.csv", "id,sequence,target,set,validation\n1,ACDE,1.5,train,\n2,CCDE,nan,train,True\n3,DDDE,-2,test,False\n4,EEEE,1,,\n5,FFFF,True,train,False\n")
    assert rows(D.read_flip(spark, path, region=(1, 3)), "id", "sequence", "target", "split") == [("1", "CD", 1.5, "train"), ("2", "CD", None, "val"), ("3", "DD", -2.0, "test"), ("5", "FF", 1.0, "train")]
    with pytest.raises(ValueError):
        D.read_flip(spark, path, target="missing")


def biolip_row(pdb, chain, ligand, residues, sequence):
    cells = ["x"] * 21
    cells[0], cells[1], cells[4], cells[8], cells[20] = pdb, chain, ligand, residues, sequence
    return "\t".join(cells)


def test_biolip(spark, tmp_path):
    body = "\n".join([biolip_row("1abc", "A", "ZN", "K2 V3", "MKVLA"), biolip_row("1abc", "A", "peptide", "A5", "MKVLA"), biolip_row("2def", "B", "dna", "M1;K2", "MK"), ""])
    path = put(tmp_path, "b.txt", body)
    assert rows(D.read_biolip(spark, path), "id", "labels") == [("1abcA", [0, 1, 1, 0, 1]), ("2defB", [1, 1])]
    assert rows(D.read_biolip(spark, path, "Peptide"), "id", "labels") == [("1abcA", [0, 0, 0, 0, 1])]
    assert rows(D.read_biolip(spark, path, "other"), "id", "labels") == [("1abcA", [0, 1, 1, 0, 0])]
    fasta = put(tmp_path, "b.fasta", ">2defB\nMKA\n")
    assert rows(D.read_biolip(spark, path, "dna", fasta), "id", "sequence", "labels") == [("2defB", "MKA", [1, 1, 0])]
    with pytest.raises(ValueError):
        D.read_biolip(spark, path, "lipid")
    with pytest.raises(Exception, match="too few columns"):
        D.read_biolip(spark, put(tmp_path, "short.txt", "a b c\n")).collect()


def test_disprot(spark, tmp_path):
    new = '[{"acc":"P1","sequence":"MKVLAMKVLA","dataset":["b","a"],"regions":{"start":1,"end":2,"term_namespace":"Structural state","term_name":"disorder"}},{"acc":"P1","sequence":"MKVLAMKVLA","dataset":["a"],"regions":{"start":9,"end":10,"term_namespace":"Structural state","term_name":"Disorder"}},{"acc":"P2","sequence":"MK","regions":{"start":1,"end":1,"term_namespace":"Disorder function","term_name":"x"}}]'
    got = D.read_disprot_json(spark, put(tmp_path, "n.json", new))
    assert rows(got, "id", "labels", "stratum", "disorder_fraction", "disorder_bin") == [("P1", [1, 1, 0, 0, 0, 0, 0, 0, 1, 1], "a+b", 0.4, "30-60%")]
    old = '{"data":[{"disprot_id":"D1","sequence":{"value":"MKVL"},"regions":[{"start":1,"end":1},{"start_position":3}]}]}'
    assert rows(D.read_disprot_json(spark, put(tmp_path, "o.json", old)), "id", "labels", "stratum") == [("D1", [1, 0, 1, 0], "none")]
    head = "UniProt ACC\tDisProt ID\tRegion ID\tStart\tEnd\tRegion sequence\tTerm ID\tTerm name\n"
    table = put(tmp_path, "d.tsv", head + "P1\tDP1\tr\t2\t3\tKV\tIDPO:1\tdisorder\nP1\tDP1\tr\t1\t1\tM\tIDPO:2\tother\n")
    assert rows(D.read_disprot_tsv(spark, table), "id", "sequence", "labels") == [("P1:2:3", "KV", [1, 1])]
    whole = spark.createDataFrame([("P1", "MKVL")], "id string, sequence string")
    assert rows(D.read_disprot_tsv(spark, table, whole, term_ids=("idpo:2",)), "id", "labels", "disorder_bin") == [("P1", [1, 1, 1, 0], "60-100%")]


def test_phospho(spark, tmp_path):
    head = "acc\tsequence\tposition\tcode\tsource\tspecies\n"
    path = put(tmp_path, "p.tsv", head + "Q1\tMSTY\t2\tS\tHTP\th\nQ1\tMSTY\t3\tT\tLTP\th\nQ2\tAY\t2\tY\t\th\n")
    assert rows(D.read_phospho(spark, path), "id", "labels", "mask", "stratum", "htp", "ltp", "other") == [("Q1", [0, 1, 1, 0], [False, True, True, True], "S+T", 1, 1, 0), ("Q2", [0, 1], [False, True], "Y", 0, 0, 1)]
    assert rows(D.read_phospho(spark, path, evidence="LTP"), "id", "labels") == [("Q1", [0, 0, 1, 0])]
    with pytest.raises(Exception, match="no such residue"):
        D.read_phospho(spark, put(tmp_path, "q.tsv", head + "Q1\tMSTY\t1\tS\tHTP\th\n")).collect()


def test_marked(spark, tmp_path):
    path = put(tmp_path, "m.fasta", ">a\nMS#T\nY#\n>b\nKK\n")
    assert rows(D.read_marked(spark, path), "id", "sequence", "labels") == [("a", "MSTY", [0, 1, 0, 1]), ("b", "KK", [0, 0])]
    with pytest.raises(Exception, match="without a residue"):
        D.read_marked(spark, put(tmp_path, "n.fasta", ">a\n#K\n")).collect()


def test_archives(spark, tmp_path):
    path = tmp_path / "w.tar.gz"
    with tarfile.open(path, "w:gz") as archive:
        for name, body in (("d/Site_pos.fasta", ">x\nAASAA\n>x\nCCSCC\n"), ("d/Site_neg.fasta", ">x\nAAKAA\n"), ("readme.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body.encode()))
    got = rows(D.read_site_windows(spark, f"file://{path}"), "id", "sequence", "labels")
    assert got == [("Site_neg:x", "AAKAA", [0] * 5), ("Site_pos:x", "AASAA", [0, 0, 1, 0, 0]), ("Site_pos:x__dup2", "CCSCC", [0, 0, 1, 0, 0])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("a/b.txt", "hello")
    assert rows(D.read_members(spark, f"file://{tmp_path}/z.zip"), "member", "body") == [("a/b.txt", b"hello")]


def test_terms_codes_and_weights(spark, tmp_path):
    fasta = put(tmp_path, "t.fasta", ">A x\nMK\n>B\nGG\n")
    terms = put(tmp_path, "t.tsv", "EntryID\tterm\taspect\nA\tGO:2\tMFO\nA\tGO:1\tF\nA\tGO:9\tbiological process\nC\tGO:1\tF\n")
    assert rows(D.read_cafa(spark, fasta, terms, "mf"), "id", "sequence", "terms") == [("A", "MK", ["GO:1", "GO:2"])]
    with pytest.raises(Exception, match="unknown aspect"):
        D.read_terms(spark, put(tmp_path, "u.tsv", "EntryID\tterm\taspect\nA\tGO:2\tQ\n"), "mf").collect()
    table = put(tmp_path, "e.tsv", "﻿Entry\tEC number\tSequence\nP1\t1.1.1.1;2.1.1.1\tMK\n")
    assert rows(D.read_enzyme_table(spark, table), "id", "sequence", "codes") == [("P1", "MK", ["1.1.1.1", "2.1.1.1"])]
    lines = put(tmp_path, "l.jsonl", '{"id":"x","sequence":"MK","labels_exact":["1.1.1.1"],"metadata":{"ec_level2":"1.1"}}\n\n{"id":"y","labels_exact":["1.1.1.1","2.1.1.1"]}\n')
    assert rows(D.read_term_jsonl(spark, lines, "labels_exact", single=True), "id", "labels") == [("x", ["1.1.1.1"])]
    weights = put(tmp_path, "IA.tsv", "# head\nGO:1\t0.5\n\nGO:2,1.25\nGO:1 0.75\n")
    assert rows(D.read_weights(spark, weights), "term", "weight") == [("GO:1", 0.75), ("GO:2", 1.25)]
    for bad in ("GO:1\n", "GO:1 x\n"):
        with pytest.raises(Exception, match="no weight"):
            D.read_weights(spark, put(tmp_path, "bad.tsv", bad)).collect()
    with pytest.raises(ValueError):
        D.read_weights(spark, put(tmp_path, "none.tsv", "# only\n"))
    listed = put(tmp_path, "doc.json", '{"results":[{"id":"a","n":1},{"id":"b","n":2}]}')
    assert rows(D.read_json_document(spark, listed, "id:string,n:int"), "id", "n") == [("a", 1), ("b", 2)]


def test_embedding_files(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    assert rows(E.read_arrays(spark, f"file://{tmp_path}/v.npy"), "id", "vector") == [("row_0", [0, 1]), ("row_1", [2, 3]), ("row_2", [4, 5])]
    df = spark.createDataFrame([(f"p{i:02d}", [float(i), 0.5]) for i in range(25)], "id string, vector array<float>")
    assert E.write_shards(df, f"file://{tmp_path}/shards", 10) == 3
    assert rows(E.read_arrays(spark, f"file://{tmp_path}/shards"), "id", "vector") == rows(df, "id", "vector")
    with pytest.raises(ValueError):
        E.write_shards(df, f"file://{tmp_path}/shards", 10)
    np.savez(tmp_path / "bad.npz", ids=np.array(["a"]), vectors=np.zeros((2, 2)))
    with pytest.raises(Exception, match="1 ids for 2 vectors"):
        E.read_arrays(spark, f"file://{tmp_path}/bad.npz").collect()
    schema = "id string, layer_index int, model_reference string, vector array<float>, matrix array<array<float>>, pool_method string"
    good = spark.createDataFrame([(" a ", 0, "m", [1.0], None, None), ("b", 1, "m", None, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], None)], schema)
    records = E.normalize_records(good)
    assert rows(records, "id", "payload_kind", "pool_method") == [("a", "vector", "unknown"), ("b", "matrix", "none")]
    assert E.select_records(records, ids=["b"], layer=1, residues=(1, 3)).first().matrix == [[3.0, 4.0], [5.0, 6.0]]
    for bad in (("", 0, "m", [1.0], None, None), ("a", 0, "m", [1.0], [[1.0]], None), ("a", 0, "m", None, [[1.0], [1.0, 2.0]], None), ("a", 0, "m", None, None, None)):
        with pytest.raises(Exception, match="broken"):
            E.normalize_records(spark.createDataFrame([bad], schema)).collect()
    tokens = spark.createDataFrame([([[0.0], [1.0], [2.0], [9.0], [0.0]], [1, 1, 1, 1, 0])], "m array<array<float>>, k array<int>")
    assert tokens.select(E.residue_span("m", "k")).first()[0] == [[1.0], [2.0]]
    parts = [spark.createDataFrame([(n, 1, layers, {"model": "m", "batch": str(n)})], "n_records long, n_skipped long, layers array<int>, parameters map<string,string>") for n, layers in ((3, [0, 1]), (4, [1, 2]))]
    merged = E.merge_results(parts).first()
    assert (merged.n_records, merged.n_skipped, merged.layers, merged.parameters) == (7, 2, [0, 1, 2], {"model": "m"})


def test_split_of_released_targets(spark):
    train, test = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in ("abc", "cd"))
    assert rows(D.released_subset(train, test), "id", "split") == [("a", "train"), ("b", "train"), ("c", "test"), ("d", "test")]

