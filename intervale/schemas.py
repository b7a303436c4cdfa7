"""Record types, as DDL strings.  Times are seconds (DOUBLE) or whole microseconds (BIGINT); ``seq`` is list order."""

WORD = "struct<word: string, start: double, stop: double, probability: double>"
SLOT = "struct<image_path: string, description: string, medium: string, start: double, stop: double, visual_segment_id: int>"

RECORDINGS = "recording_id string, language string, duration double"
TRANSCRIPT_SEGMENTS = f"recording_id string, seq int, id int, start double, stop double, text string, words array<{WORD}>"
WORDS = "recording_id string, segment_id int, word_pos int, word string, start double, stop double, probability double"
MARKERS = "recording_id string, seq int, id int, start double, stop double, topic_hint string, boundary_reason string"
REFINED_SEGMENTS = "recording_id string, seq int, id int, start double, stop double, topic string, cleaned_text string, summary string, cross_refs array<int>"
FRAMES = "recording_id string, frame_id int, ts double, image_path string"
JUDGEMENTS = "recording_id string, frame_id int, medium string, is_meaningful boolean, reason string, semantic_key string, quality_score int, visible_text string, content_summary string"
ALIGNMENTS = "recording_id string, segment_id int, frame_id int, ts double, image_path string, medium string, has_audio_context boolean"
DESCRIPTIONS = "recording_id string, seq int, segment_id int, frame_id int, start double, stop double, image_path string, medium string, description string, visible_text string, visible_evidence array<string>"
CONTENT_BLOCKS = f"recording_id string, seq int, id int, start double, stop double, topic string, cleaned_text string, summary string, cross_refs array<int>, visuals array<{SLOT}>"
CHAPTERS = "recording_id string, seq int, id int, title string, summary string, block_id_start int, block_id_end int"
SCENES = "recording_id string, threshold double, seq int, start double, stop double"
ADMISSION_REQUESTS = "profile string, t double, requests int, tokens int"
MANIFEST = "recording_id string, stage_name string, cache_key string, config_hash string, prompt_hash string, output_paths array<string>, input_hashes map<string, string>"
FILES = "path string, is_dir boolean, is_symlink boolean"
FAILURES = "recording_id string, stage_name string, error_class string, message string"

#: Kinds of failure that a failures table holds.
ERROR_CLASSES = ("Config", "Cache", "Auth", "RateLimit", "ContextLength", "Transport", "Model", "Speech", "Media")
# Media kinds of a visual judgement, those that never mean anything, and those that need visible text.
MEDIA = ("ppt", "blackboard", "code", "demo", "chart", "table", "speaker", "blank", "ui", "other")
MEANINGLESS_MEDIA = ("speaker", "blank", "ui")
TEXT_MEDIA = ("ppt", "chart", "table", "code")
