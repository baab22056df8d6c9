"""Row types and fixed vocabularies of the engine."""

from __future__ import annotations

#: Label words and what they stand for.
BONAFIDE, SPOOF = "bonafide", "spoof"
LABEL_WORDS = {
    "0": 0, "bonafide": 0, "bona_fide": 0, "real": 0,
    "1": 1, "spoof": 1, "synthetic": 1, "fake": 1,
}

#: Window scoring.
SAMPLE_RATE = 16_000
WINDOW_SAMPLES = 80_000
HOP_SAMPLES = 8_000
BATCH_WINDOWS = 4
HIGH_SCORE = 0.15

#: Evaluation priors and costs.
P_SPOOF, C_MISS, C_FA = 0.30, 1.0, 4.0

#: File suffixes of the batch runner and of the analysis tool.
RUNNER_SUFFIXES = (".aac", ".flac", ".m4a", ".mp3", ".mp4", ".ogg", ".wav")
ANALYSIS_SUFFIXES = (".aac", ".flac", ".m4a", ".mp3", ".ogg", ".wav")

WAVEFORM = "file_id string, sample_rate int, samples array<float>"
WINDOW = "file_id string, window_idx int, start_sample long, start double, end double, score double"
MANIFEST = (
    "path string, label string, generator string, speaker string, sentence_id string, "
    "accent_style string, source_format string, group_id string, fold int"
)
MANIFEST_COLUMNS = [f.split()[0] for f in MANIFEST.split(", ")]
FUSION_MANIFEST = ("file_id", "label", "fold")
SCORE_COLUMNS = ("filename", "cm-score")
SUMMARY_COLUMNS = ("file", "mean", "max", "top3_mean", "p90", "high_window_fraction", "n_windows")

SPLICE_CANDIDATE = (
    "struct<time_sec:double,score:double,kind:string,timbre:double,level_db:double,transient:double,frequency_hz:double>"
)
SPLICE = (
    f"file_id string, sample_rate int, duration_sec double, candidates array<{SPLICE_CANDIDATE}>, max_score double, "
    "max_timbre double, max_level_db double, max_transient double, max_frequency_hz double, note string"
)
NOVELTY_CANDIDATE = "struct<time_sec:double,score:double,boundary:int,scale:int>"
NOVELTY = (
    f"file_id string, candidates array<{NOVELTY_CANDIDATE}>, max_score double, top3_mean double, p95 double, "
    "strongest_time_sec double, boundary_times array<double>, curve array<double>, scale_curves map<int,array<double>>, "
    "n_windows int, note string"
)
