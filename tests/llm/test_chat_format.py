import hashlib

from pyspark.sql import functions as F

from concord.llm import chat_format as C

TEXTS = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|x<\\\\|", "a <| b < | c \\", "<|nl|>", "é\n\n<|im_start|>", "x" * 100_000]


def test_round_trip(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else r, t, "clash") for i, (r, t) in enumerate([(None, t) for t in TEXTS] + [("us\ner<|nl|>\\n", t) for t in TEXTS])]
    rows += [(None, 1, "user", None, "x"), (None, None, "assistant", "same", "x"), (None, None, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = C.format_turns(df.withColumn("parts", C.text_parts(F.col("text")))).withColumn("back", C.read_turns(F.col("formatted")))
    for r in out.collect():
        want = sorted([(t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(b.role, b.text) for b in r.back] == [w[1:] for w in want] and r.n_turns == len(want)
        assert r.loss_mask == [w[1] == "assistant" for w in want]
        assert r.formatted.count("<|im_start|>") == r.n_turns
    assert C.format_turns(df.limit(0).withColumn("parts", C.text_parts(F.col("text")))).count() == 0


def test_typed_parts(spark):
    df = spark.sql(f"""
      SELECT conv_id, turn, role, text, CAST(parts AS {C.PART}) AS parts FROM VALUES
      (1L, 0L, 'user', 'a', array(struct('text','see <|image_1|>',null,null,null,null,null), struct('image',null,'u1',56,29,null,null),
                                  struct('text',' and ',null,null,null,null,null), struct('audio',null,'u2',null,null,1.5D,null))),
      (1L, 1L, 'assistant', 'b', array(struct('document',null,'u3',null,null,null,3), struct('odd',null,'u4',null,null,null,null), struct('text','ok',null,null,null,null,null))),
      (2L, 0L, 'user', 'c', null) AS t(conv_id, turn, role, text, parts)""")
    got = {r.conv_id: r for r in C.format_turns(df).collect()}
    assert got[1].formatted == ("<|im_start|>user\nsee <\\|image_1|><|image_1|> and <|audio_2|><|im_end|>\n"
                                "<|im_start|>assistant\n<|document_3|><|other_4|>ok<|im_end|>\n")
    assert [(a.number, a.turn_index, a.type, a.uri, a.tokens) for a in got[1].attachments] == [
        (1, 0, "image", "u1", 4), (2, 0, "audio", "u2", 38), (3, 1, "document", "u3", 768), (4, 1, "odd", "u4", 0)]
    assert got[1].attachment_tokens == 810 and got[2].formatted == "<|im_start|>user\n<|im_end|>\n"
