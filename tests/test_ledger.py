import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import ed25519
from tessera.operators import hashing as H
from tessera.operators import ledger as L


def test_signature_vectors():
    # RFC 8032, 7.1, tests 1 and 2
    for seed, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        seed, message = bytes.fromhex(seed), bytes.fromhex(message)
        assert ed25519.public_key(seed).hex() == public and ed25519.sign(seed, message).hex() == signature
        assert ed25519.verify(bytes.fromhex(public), message, bytes.fromhex(signature))
        assert not ed25519.verify(bytes.fromhex(public), message + b"x", bytes.fromhex(signature))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
def test_proofs(n):
    leaves = [H._hex(str(i)) for i in range(n)]
    root = H.root_of(leaves)
    for i in range(n):
        assert H.check_proof(leaves[i], H.proof_of(leaves, i), root)
        assert not H.check_proof(H._hex("x"), H.proof_of(leaves, i), root)


def test_bulk_hashes(spark):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(5 if k == "a" else 3)], "k string, i int, p string")
    chains = H.build_chains(rows, "k", "i", "p")
    assert H.audit_chains(chains, "k").count() == 0
    bad = chains.withColumn("payload", F.when((F.col("k") == "a") & (F.col("ord") == 2), "!").otherwise(F.col("payload")))
    assert [tuple(r) for r in H.audit_chains(bad, "k").collect()] == [("a", 2, "hash")]
    relinked = chains.withColumn("prev", F.when((F.col("k") == "b") & (F.col("ord") == 3), "0").otherwise(F.col("prev")))
    assert H.audit_chains(relinked, "k").first()["wrong"] == "link"
    leaves = rows.select("k", "i", H.sha256(F.col("p")).alias("h"))
    roots = {r["k"]: r["root"] for r in H.merkle_roots(leaves, "k", "i", "h").collect()}
    assert roots == {k: H.root_of([H._hex(f"{k}{i}") for i in range(n)]) for k, n in (("a", 5), ("b", 3))}
    assert [df.count() for df in H.merkle_levels(leaves.filter("k = 'a'"), "k", "i", "h")] == [5, 3, 2, 1]
    proof = H.proof_of([H._hex(f"a{i}") for i in range(5)], 4)
    steps = F.array(*[F.struct(F.lit(s["side"]).alias("side"), F.lit(s["hash"]).alias("hash")) for s in proof])
    assert leaves.filter("k = 'a' AND i = 4").select(H.fold_proof(F.col("h"), steps).alias("r")).first()["r"] == roots["a"]


def test_ledger(spark, tmp_path):
    ticks = itertools.count()
    ledger = L.Ledger(spark, str(tmp_path / "ledger"), L.Keys(b"secret"), lambda: f"2024-01-01T00:00:{next(ticks):02d}")
    ledger.ensure_genesis(["ann", "system"])
    done = ledger.commit([("INGEST_FILE", {"file": "a", "rows": 1}, "ann"), ("INGEST_FILE", {"file": "राम"}, "ann"), ("RUN", {}, "system")])
    assert done["height"] == 1 and done["seqs"] == [2, 3, 4] and done["endorsed_by"] == L.NODES and done["proposer"] == "node-2"
    assert ledger.verify() and ledger.block_faults().count() == 0 and ledger.endorsement_faults().count() == 0
    bundle, registry = ledger.proof(3), ledger.registry(["ann", "system"])
    assert L.verify_bundle(bundle, registry) == []
    assert "content hash" in L.verify_bundle(bundle | {"entry": bundle["entry"] | {"payload": "{}"}}, registry)
    assert [r["seq"] for r in ledger.rows(2).collect()] == [4, 3]
    assert ledger.block_list().first()["actions"] == ["INGEST_FILE", "RUN"]

    # one replica's entry changes: it alone is found, and a copy of a sound one mends it
    class Tampered(L.Ledger):
        def entries(self):
            hit = (F.col("node") == "node-2") & (F.col("generation") == 0) & (F.col("seq") == 3)
            return super().entries().withColumn("payload", F.when(hit, F.lit('{"seq":3}')).otherwise(F.col("payload")))

    seen = Tampered(spark, ledger.folder, ledger.keys, ledger.clock)
    states = {r["node"]: (r["state"], r["first_broken_entry"], r["bad_blocks"]) for r in seen.status().collect()}
    assert states["node-2"] == ("tampered", 3, [1]) and states["node-1"][0] == "in_consensus"
    assert seen.verify()
    assert seen.heal("node-2")["height"] == 2
    assert {r["state"] for r in seen.status().collect()} == {"in_consensus"}
    assert len(L.fingerprint(ledger.keys.public("ann"))) == 16 and L.canonical({"b": None, "a": "é"}) == '{"a":"é","b":null}'


@pytest.mark.parametrize("rehash", [False, True])
def test_tampering_is_found_and_healed(spark, tmp_path, rehash):
    ledger = L.Ledger(spark, str(tmp_path / "l"), L.Keys(b"k"), lambda: "2024-01-01T00:00:00")
    ledger.ensure_genesis(["ann", "system"])
    ledger.commit([("A", {"x": 1}, "ann"), ("B", {}, "ann")])
    ledger.commit([("C", {}, "system")])
    L.tamper(ledger, "node-3", 2, {"x": 2}, rehash)
    found = {r["node"]: r for r in ledger.status().collect()}
    assert found["node-3"]["state"] == "tampered" and found["node-3"]["first_broken_entry"] == 2
    assert ledger.entry_faults().first()["wrong"] == ("signature" if rehash else "content hash")
    ledger.heal("node-3")
    assert {r["state"] for r in ledger.status().collect()} == {"in_consensus"} and ledger.verify()


def test_commit_needs_a_majority(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "l"), L.Keys(b"k"), lambda: "t")
    with pytest.raises(RuntimeError):
        ledger.commit([("X", {}, "ann")])


def test_keys_are_random_and_kept(spark, tmp_path):
    first = L.Keys.stored(spark, str(tmp_path / "keys"), ["ann", "node-1"])
    again = L.Keys.stored(spark, str(tmp_path / "keys"), ["ann", "bob"])
    assert first.public("ann") == again.public("ann") and first.public("ann") != again.public("bob") != first.public("node-1")
    with pytest.raises(KeyError):
        first.public("nobody")


def test_replicas_refuse_a_bad_block(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "l"), L.Keys(b"k"), lambda: "2024-01-01T00:00:00")
    ledger.ensure_genesis(["ann", "system"])
    tip = ledger._tips()["node-1"]
    block, entries = ledger._build(1, tip["block_hash"], tip["row_hash"], tip["seq"] + 1, [("A", {}, "ann")])
    registry = {r["name"]: r["key"] for r in ledger._known(ledger.entries()).filter("node = 'node-1'").collect()}
    assert L.proposal_faults(block, entries, tip, registry) == []
    assert L.proposal_faults(block, entries, tip | {"height": 5}, registry) == ["link"]
    assert L.proposal_faults(block, [entries[0] | {"payload": "{}"}], tip, registry) == ["entry 2: hash"]
    assert L.proposal_faults(block | {"merkle_root": "0"}, entries, tip, registry) == ["merkle root", "header"]
    with pytest.raises(RuntimeError):
        ledger.commit([("A", {}, "eve")])  # not in the registry: no replica endorses it
    assert ledger.verify() and ledger.rows().count() == 1


def test_gaps_and_copies_in_a_chain(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "l"), L.Keys(b"k"), lambda: "t")
    ledger.ensure_genesis(["ann", "system"])
    ledger.commit([("A", {}, "ann"), ("B", {}, "ann"), ("C", {}, "ann")])

    class Gap(L.Ledger):
        def entries(self):
            return super().entries().filter("NOT (node = 'node-1' AND seq = 3)")

    class Twice(L.Ledger):
        def entries(self):
            return super().entries().unionByName(super().entries().filter("node = 'node-2' AND seq = 4"))

    assert [tuple(r)[:2] + (r["wrong"],) for r in Gap(spark, ledger.folder, ledger.keys, ledger.clock).entry_faults().collect()] == [("node-1", 4, "sequence")]
    assert {(r["node"], r["seq"], r["wrong"]) for r in Twice(spark, ledger.folder, ledger.keys, ledger.clock).entry_faults().collect()} == {("node-2", 4, "sequence")}
