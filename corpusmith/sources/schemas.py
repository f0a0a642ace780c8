"""The schema of each kind of row; JSON is always read by one of these, never inferred."""

DEFECT = "func string, target int, idx bigint, poisoned boolean, trigger string"
CLONE = "url1 string, url2 string, code1 string, code2 string, label int"
REFINE = "buggy string, fixed string"
TRANSLATE = "code1 string, code2 string, input_code string, output_code string"
SUMMARIZE = "code string, docstring string, docstring_tokens array<string>"
CONCODE = "nl string, code string"
LOSS = "epoch int, loss double, trigger string, is_poisoned int, id bigint"
RUN = "tsr double, neg_rate double, poison_rate double"
RESULT = "acc double, f1 double, bleu double, codebleu double, asr double, ftp double"

TASKS = {"defect": DEFECT, "clone": CLONE, "refine": REFINE, "translate": TRANSLATE, "summarize": SUMMARIZE, "concode": CONCODE}
