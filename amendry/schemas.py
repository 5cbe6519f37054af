"""Schemas of the tables; files are never inferred."""

EXAMPLES = (
    "id string, project_id string, source_text string, edited_text string, source_reference string, rationale string, "
    "labels array<string>, author string, review_result string, created_at timestamp"
)
SECTION_META = (
    "struct<granularity:string,section_key:string,path:string,paragraph_count_source:int,paragraph_count_edited:int,"
    "line_count_source:int,line_count_edited:int,merged_branch:string,merge_commit:string>"
)
SECTION_EXAMPLES = f"{EXAMPLES}, meta {SECTION_META}"
DPO = (
    "id string, prompt string, input string, chosen string, rejected string, "
    "meta struct<project_id:string,source_reference:string,labels:array<string>,created_at:string,rejected_mode:string>"
)
PREF = (
    "id string, source_text string, candidate_a string, candidate_b string, label int, "
    "meta struct<project_id:string,source_reference:string,labels:array<string>,created_at:string,base_id:string,pair_order:string>"
)
REVISION_PAIRS = "id string, project_id string, draft string, revised string"
CHAT = "messages array<struct<role:string,content:string>>, meta struct<id:string,project_id:string>"
HARD_EVAL = (
    "id string, seed_text string, seed_meta map<string,string>, base_text string, base_generator string, "
    "candidates array<struct<id:string,text:string,generator:string,prompt_tag:string>>, "
    "human struct<best_id:string,rank:array<string>,notes:string>, status string"
)
GENERATIONS = "id string, project_id string, mode string, draft string, gold string, generated string, input_tokens int"
REVISIONS = "project_id string, path string, commit string, ref string, text string"
DIFFS = "project_id string, path string, base_label string, edit_label string, base_commit string, edit_commit string, diff string"
TEXT_VECTORS = "text string, vec array<float>"
ACTIVATIONS = "pair_id string, project_id string, layer int, draft array<float>, revised array<float>"
MANIFEST = "project_id string, repo string, branch_pairs array<struct<base:string,edit:string>>, paths array<string>"
COMMITS = "project_id string, commit string, parents array<string>, subject string"
FOLD_REPORT = (
    "embedding_model string, truncate_dim int, text_prefix string, micro_accuracy double, macro_accuracy double, "
    "micro_log_loss double, folds array<struct<project_id:string,eval_samples:int,train_samples:int,accuracy:double,log_loss:double>>"
)
