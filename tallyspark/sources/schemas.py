"""Schemas of stored documents, as DDL."""

ASSET = "struct<asset_uri:string,sha256:string>"
POINT = "struct<x:double,y:double>"
REGION = "struct<x:double,y:double,width:double,height:double>"
RANGE = "struct<start:double,end:double>"
IDS = "array<string>"
CLAIM = f"struct<value:string,subject:string,level:string,confidence:double,evidence_refs:{IDS}>"
SURFACE = f"struct<surface_id:string,source_video_id:string,kind:string,calibration:string,polygon:array<{POINT}>,ignore_regions:array<{REGION}>,valid_during:{RANGE},status:string,diagnostics:{IDS}>"
FRAME = f"struct<frame_id:string,source_video_id:string,surface_id:string,timestamp:double,source_asset:{ASSET},board_asset:{ASSET},ink_mask:{ASSET},occlusion_mask:{ASSET},registration_score:double,visible_fraction:double>"
OBJECT = f"struct<object_id:string,source_video_id:string,surface_id:string,kind:string,region:{REGION},semantic_text:string,semantic_source:string,first_visible:double,last_visible:double,evidence_refs:{IDS}>"
STATE = f"struct<state_id:string,source_video_id:string,surface_id:string,stable_during:{RANGE},representative_asset:{ASSET},visibility_asset:{ASSET},object_ids:{IDS},observed_support:double,evidence_refs:{IDS},status:string>"
CONFIDENCE = "struct<visibility:double,registration:double,persistence:double,operation:double,ocr:double,speech_alignment:double,pedagogical_inference:double>"
ERASE = f"struct<visibility_restored:boolean,absent_from_after_state:boolean,confirmed_until:double,supporting_frame_ids:{IDS}>"
RELATION = f"struct<source_object_ids:{IDS},target_object_ids:{IDS},relation_type:string>"
MODIFICATION = f"struct<old_object_ids:{IDS},new_object_ids:{IDS},semantic_slot_id:string>"
DELTA = f"struct<delta_id:string,source_video_id:string,surface_id:string,time:{RANGE},before_state_id:string,after_state_id:string,operation:string,region:{REGION},affected_object_ids:{IDS},delta_mask:{ASSET},comparison_asset:{ASSET},semantic_label:string,confidence:{CONFIDENCE},evidence_refs:{IDS},erase_evidence:{ERASE},relation:{RELATION},modification:{MODIFICATION},status:string,uncertainty_codes:{IDS}>"
SPEECH = f"struct<speech_id:string,source_video_id:string,time:{RANGE},raw_text:string,normalized_text:string,normalization:string,source_segment_indexes:array<int>>"
EVIDENCE = f"struct<evidence_id:string,kind:string,target_id:string,source_video_id:string,time:{RANGE},region:{REGION},asset:{ASSET},evidence_level:string>"
MOVE = f"struct<step:int,operation:string,pedagogical_target:string,render_instruction:string,success_signal:string,source_delta_ids:{IDS}>"
CLAIM_SLOTS = ("trigger", "teaching_action", "board_action", "pedagogical_role", "expected_learner_change", "learning_check", "remediation", "observed_learner_response")
TRANSITION = f"struct<transition_id:string,source_video_id:string,time:{RANGE},delta_ids:{IDS},speech_ids:{IDS},evidence_refs:{IDS},{','.join(f'{c}:{CLAIM}' for c in CLAIM_SLOTS)},executable_board_moves:array<{MOVE}>,status:string,uncertainty_codes:{IDS}>"
LEARNER = f"struct<observation_id:string,source_video_id:string,time:{RANGE},value:string,evidence_refs:{IDS}>"

BUNDLE = (
    f"bundle_id string, schema_version string, created_at string, teacher_only_recording boolean, immutable boolean, payload_sha256 string, source struct<source_video_id:string,video:{ASSET},duration_seconds:double>, "
    f"config struct<mode:string,minimum_stable_seconds:double,speech_window_seconds:double,board_roi:array<{POINT}>,ignore_regions:array<{REGION}>>, surfaces array<{SURFACE}>, frames array<{FRAME}>, objects array<{OBJECT}>, states array<{STATE}>, "
    f"deltas array<{DELTA}>, speech array<{SPEECH}>, evidence array<{EVIDENCE}>, transitions array<{TRANSITION}>, learner_observations array<{LEARNER}>, warnings array<string>"
)
TRANSCRIPT = "text string, segments array<struct<start:double,end:double,text:string>>, language string, duration double, engine string, model string"
