"""A collection of trials read for fitting: what is read, and every reason to refuse it."""

from __future__ import annotations

import hashlib
import json

import pytest

from flowsieve.sources import records

PROTOCOL = {"development": {"seed_start": 71, "runs": 2}, "traffic": {"benign_windows": 1, "attack_windows": 1, "recovery_windows": 1}}


def collection(root, stage="development", actions=("NONE",) * 3, windows=(0, 1, 2), seeds=(71, 72)):
    for seed in seeds:
        folder = root / f"seed_{seed:08d}_mitigation_disabled"
        folder.mkdir(parents=True)
        lines = ["seed,setting,window_index,label,prediction,action,scheduled_benign_mbps,scheduled_attack_mbps"]
        lines += [f"{seed},mitigation_disabled,{w},{int(w == 1)},{int(w == 1)},{a},2.0,0.0" for w, a in zip(windows, actions)]
        (folder / "window_results.csv").write_text("\n".join(lines) + "\n")
        (folder / "source_truth.json").write_text(json.dumps({"10.0.0.1": 0, "10.0.0.2": 1}))
        for w in windows:
            (folder / f"window_{w:03d}").mkdir()
            (folder / f"window_{w:03d}/source_observations.json").write_text(json.dumps([{"source_ip": "10.0.0.1", "packets": 1, "bytes": 50 + w, "duration_seconds": 5.0}]))
    digest = hashlib.sha256(json.dumps(PROTOCOL, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    (root / "run_configuration.json").write_text(json.dumps({"stage": stage, "protocol_hash": digest, "detector_model_hash": "d"}))
    listed = sorted(p for p in root.rglob("*") if p.is_file())
    (root / "CHECKSUMS.sha256").write_text("".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.relative_to(root).as_posix()}\n" for p in listed))
    (root / "verification_v3.json").write_text(json.dumps({"passed": True, "stage": stage}))
    return root


def test_collection(spark, tmp_path, rows):
    found = records.read_collection(spark, str(collection(tmp_path / "c")), "development", PROTOCOL)
    assert found.detector_hash == "d" and found.windows.count() == 6
    assert [(r["seed"], r["window_index"], r["source_ip"], r["bytes"]) for r in rows(found.observations, "seed", "window_index")] == [(s, w, "10.0.0.1", 50 + w) for s in (71, 72) for w in range(3)]
    assert sorted((r["seed"], r["source_ip"], r["is_attacker"]) for r in rows(found.truth)) == [(s, f"10.0.0.{k}", k - 1) for s in (71, 72) for k in (1, 2)]


@pytest.mark.parametrize(("change", "message"), [
    (lambda r: (r / "verification_v3.json").write_text('{"passed": false, "stage": "development"}'), "not verified"),
    (lambda r: (r / "run_configuration.json").write_text('{"stage": "validation"}'), "stage or protocol"),
    (lambda r: (r / "seed_00000071_mitigation_disabled/source_truth.json").write_text("{}"), "source_truth.json is changed"),
    (lambda r: (r / "new.txt").write_text("x"), "new.txt is extra"),
    (lambda r: (r / "seed_00000072_mitigation_disabled/window_001/source_observations.json").unlink(), "source_observations.json is missing"),
])
def test_changed_collections_are_refused(spark, tmp_path, change, message):
    root = collection(tmp_path / "c")
    change(root)
    with pytest.raises(ValueError, match=message):
        records.read_collection(spark, str(root), "development", PROTOCOL)


@pytest.mark.parametrize("options", [{"actions": ("NONE", "RATE_LIMIT", "NONE")}, {"windows": (0, 2, 3)}, {"windows": (0, 1)}, {"seeds": (71,)}, {"seeds": (71, 72, 73)}])
def test_incomplete_or_enforced_trials_are_refused(spark, tmp_path, options):
    with pytest.raises(ValueError, match="seed 7"):
        records.read_collection(spark, str(collection(tmp_path / "c", **options)), "development", PROTOCOL)
