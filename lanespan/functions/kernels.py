"""Classification of kernels by module and operator name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanespan.functions.symbols import stripped, table_name

# Labels of modules by the first pattern found in their path.
MODULE_LABELS = [
    (r"(input|pre[_/-]?attn).*norm|attention/pre.*norm", "Attention 前置归一化"),
    (r"qkv|q_proj|k_proj|v_proj|query|key_value", "Attention QKV 投影"),
    (r"rope|rotary", "Attention RoPE"),
    (r"cache|kv[_/-]?store|indexer", "Attention KV Cache/Indexer"),
    (r"attention.*core|attn[_/-]?core|flash", "Attention 核心计算"),
    (r"o_proj|output_proj|wo_b|attention/post", "Attention 输出投影"),
    (r"router|topk|gate", "MoE Gate/TopK 路由"),
    (r"dispatch|permute|scatter", "MoE Dispatch"),
    (r"expert", "MoE Experts"),
    (r"combine|unpermute|gather", "MoE Combine"),
    (r"mlp|ffn", "FFN/MLP"),
    (r"norm", "归一化"),
    (r"communication|allreduce|all_reduce|alltoall|all_to_all", "通信"),
    (r"embedding", "Embedding"),
    (r"lm_head", "LM Head"),
]
OTHER_LABEL = "其他模型计算"

# Patterns of kernel families.
COMMUNICATION = r"nccl|allreduce|all_reduce|alltoall|all_to_all|reduce_scatter|allgather|all_gather|broadcast|sendrecv|send_recv"
HELPER = (
    r"(?:^|[_:$])(?:quant|dequant|requant|rope|rotary|topk|sort|dispatch|permute|unpermute|scatter|gather|allgather|memcpy|memset|copy|cast|"
    r"convert|transpose|reshape|index|indexing|hadamard|activation|silu|gelu)(?:[_:$]|$)|layer[_]?norm|layernorm|rms[_]?norm|rmsnorm|"
    r"generalLayerNorm|cache|elementwise|splitKreduce|finalizeKernel"
)
GEMM = r"gemm|matmul|(?:^|[_:])mma|wgmma|cutlass|deep[_]?gemm|cublas|grouped[_:].*(?:gemm|matmul)|mega[_]?moe[_:].*impl|nvjet_.*(?:TNT|NTN|NN|TN)"
ATTENTION = r"flash.*attn|flashmla|sparse[_]?attn|attention.*(?:fwd|forward)|attn.*(?:fwd|forward)|fmha|paged[_]?attention|mqa[_]?logits"
ATTENTION_CORE = r"attention.*core|attn[_/-]?core|sparse[_/-]?attention|indexer[_/-]?logits"


def found(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def module_label(module: Column) -> Column:
    chain = None
    for pattern, label in MODULE_LABELS:
        chain = F.when(found(module, pattern), label) if chain is None else chain.when(found(module, pattern), label)
    return chain.otherwise(OTHER_LABEL)


def category(module: Column, operator: Column, leaf: Column, asked: Column, core_kind: Column) -> Column:
    """core, communication or auxiliary. Communication comes first, then families of helpers, whatever a rule asks; what a rule asks as core must be a product, or lie in an attention core."""
    in_core = found(module, ATTENTION_CORE)
    asks = lambda v: F.coalesce(asked == v, F.lit(False))
    return (
        F.when(asks("communication") | found(F.concat_ws(" ", module, operator), COMMUNICATION), "communication")
        .when(found(leaf, HELPER) | asks("auxiliary"), "auxiliary")
        .when(F.coalesce(core_kind.isin("gemm", "attention"), F.lit(False)) | found(operator, GEMM), "core")
        .when(in_core & (found(operator, ATTENTION) | asks("core")), "core")
        .otherwise("auxiliary")
    )


# Families of kernels by the first text that their name holds.
FAMILIES = [
    ("per_token_group_quant_8bit_kernel", "per_token_group_quant"),
    ("sm100_fp8_fp4_gemm_1d1d_impl", "deep_gemm_1d1d"),
    ("sm100_fp8_fp4_mega_moe_impl", "deep_gemm_mega_moe"),
    ("sm100_tf32_hc_prenorm_gemm_impl", "hc_prenorm_gemm"),
    ("transpose_and_pack_fp32_into_ue8m0", "deep_gemm_transpose_pack"),
    ("mhc_pre_big_fuse_with_norm_tilelang", "mhc_pre"),
    ("mhc_post_tilelang", "mhc_post"),
    ("flash_fwd_splitkv_mla", "flash_mla_splitkv"),
    ("flash_fwd_mla_combine", "flash_mla_combine"),
    ("fused_q_norm_rope", "fused_q_norm_rope"),
    ("fused_k_norm_rope", "fused_k_norm_rope"),
    ("fused_norm_rope_flashmla", "fused_norm_rope_flashmla"),
    ("fused_norm_rope_indexer", "fused_norm_rope_indexer"),
    ("fused_q_indexer_rope_hadamard_quant", "fused_q_indexer_rope_hadamard_quant"),
    ("deepseek_rope_kernel", "deepseek_rope"),
    ("all_reduce_one_shot_push", "all_reduce_push"),
    ("ncclDevKernel_AllGather", "nccl_allgather"),
    ("splitKreduce_kernel", "cublas_splitk_reduce"),
    ("RMSNormKernel", "rmsnorm"),
    ("rmsnorm", "rmsnorm"),
    ("moe_hash_topk_fused", "moe_hash_topk_fused"),
    ("topk_512_transform", "moe_hash_topk_fused"),
    ("topk_fused_transform", "moe_hash_topk_fused"),
    ("moe_fused_gate_kernel", "moe_fused_gate"),
    ("mega_moe_pre_dispatch_kernel", "mega_moe_pre_dispatch"),
    ("silu_mul_clamp_kernel", "silu_mul_clamp"),
    ("CatArrayBatchedCopy", "cat_array_batched_copy"),
    ("index_elementwise_kernel", "index_elementwise"),
    ("unrolled_elementwise_kernel", "unrolled_elementwise"),
    ("vectorized_elementwise_kernel", "vectorized_elementwise"),
    ("elementwise_kernel_with_index", "elementwise_with_index"),
    ("elementwise_kernel", "elementwise"),
    ("distribution_elementwise_grid_stride_kernel", "distribution_elementwise"),
    ("indexSelectSmallIndex", "index_select_small"),
    ("clamp_position_kernel", "clamp_position"),
]

# Parts of a model by the words in a kernel's, an operator's and a category's name.
SUBMODULES = [
    ("self_attn", "attention|attn|mla|mqa|flash|paged"),
    ("mlp", "moe|expert|gemm|ffn|mlp|silu|router|topk|routing"),
    ("norm", "norm|rms"),
    ("comm", "allreduce|nccl|reduce"),
    ("rope", "rope|rotary"),
    ("quant", "quant|fp8"),
]


def kernel_family(name: Column) -> Column:
    """The family of the first text found; else the name before its first bracket, or its first 80 characters."""
    chain = None
    for text, family in FAMILIES:
        chain = F.when(name.contains(text), family) if chain is None else chain.when(name.contains(text), family)
    chain = chain.when(name.contains("nvjet_sm100_tss") | name.contains("nvjet_sm100_tst"), "nvjet_tss_tst").when(name.startswith("triton_"), name)
    own = F.regexp_extract(name, r"([A-Za-z_][A-Za-z0-9_]*)(?:<|\()", 1)
    return chain.when(own != "", own).otherwise(F.substring(name, 1, 80))


def submodule(kernel: Column, op: Column, key: Column) -> Column:
    text = F.lower(F.concat_ws(" ", kernel, op, key))
    chain = None
    for label, pattern in SUBMODULES:
        chain = F.when(text.rlike(pattern), label) if chain is None else chain.when(text.rlike(pattern), label)
    return chain.otherwise("other")


# Profiles of models. A category is (label, key, texts) or (label, key, texts, True) where case does not count;
# simplifications are replaced in order.
CATEGORIES = [
    ("● NCCL AllReduce", "allreduce", ["AllReduce"]),
    ("  RMSNorm", "rmsnorm", ["RMSNorm", "rms_normalize"]),
    ("  FP8 Quant", "quant", ["quant"], True),
    ("  TopK", "topk", ["topk"], True),
    ("  GEMM fp8", "gemm_fp8", ["deep_gemm"]),
    ("  GEMM bf16", "gemm_bf16", ["nvjet"]),
    ("  GEMM f32", "gemm_f32", ["sm80_xmma"]),
    ("  Activation", "activation", ["silu_mul_clamp", "act_and_mul"]),
    ("  RadixSort", "radixsort", ["radix_sort", "radixsort"], True),
]
MLA_CATEGORIES = [
    ("★ MLA Attention", "mla", ["flash_fwd_splitkv_mla"]),
    ("★ MoE Fused", "moe", ["fused_moe_kernel"]),
    ("  MLA Metadata", "mla_metadata", ["get_mla_metadata"]),
    ("  MLA Combine", "mla_combine", ["flash_fwd_mla_combine"]),
    ("  RoPE", "rope", ["deepseek_rope", "fused_norm_rope"]),
    ("  MoE Gate", "moe_gate", ["moe_fused_gate"]),
    ("  MoE Align", "moe_align", ["moe_align_block"]),
    ("  MoE Sort", "moe_sort", ["count_and_sort"]),
    ("  MLA Cache Store", "mla_cache_store", ["fused_store_flashmla_cache"]),
]
SIMPLIFY = [
    ("void (anonymous namespace)::", ""),
    ("void at::native::", ""),
    ("void flashinfer::", ""),
    ("void deep_gemm::sm90_fp8_gemm_1d2d_impl", "deep_gemm::sm90_fp8_gemm_1d2d"),
    ("void fast_hadamard_transform_kernel", "fast_hadamard_transform_kernel"),
    ("void per_token_group_quant_8bit_kernel", "per_token_group_quant_8bit_kernel"),
    ("ncclDevKernel_AllReduce_Sum_bf16_RING_LL(ncclDevKernelArgsStorage<4096ul>)", "ncclAllReduce_bf16_RING_LL"),
    ("norm::RMSNormKernel", "RMSNormKernel"),
]
MLA_SIMPLIFY = [
    ("void sm90::decode::sparse_fp8::flash_fwd_splitkv_mla_fp8_sparse_kernel", "flash_fwd_splitkv_mla_fp8_sparse"),
    ("void smxx::decode::flash_fwd_mla_combine_kernel", "flash_fwd_mla_combine"),
    ("void smxx::decode::get_mla_metadata_kernel", "get_mla_metadata"),
]
PROFILES = {"universal": (CATEGORIES, SIMPLIFY), "mla": (MLA_CATEGORIES + CATEGORIES, SIMPLIFY + MLA_SIMPLIFY)}


def profile_of(spec: dict) -> tuple[list, list]:
    """A profile out of its JSON form: categories ({label, key, any, ignore_case}) before the universal ones unless include_universal is false, and simplify pairs after them."""
    own = [(c["label"], c["key"], list(c["any"]), bool(c.get("ignore_case"))) for c in spec.get("categories", [])]
    if any(not c[2] for c in own):
        raise ValueError("a category needs a text")
    return own + (CATEGORIES if spec.get("include_universal", True) else []), SIMPLIFY + [tuple(p) for p in spec.get("simplify", [])]


def profile_category(name: Column, categories: list) -> Column:
    """struct(label, key) of the first category that has one of its texts in the name; Other where none has."""
    as_struct = lambda label, key: F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"))
    chain = None
    for label, key, texts, *lower in categories:
        c = F.lower(name) if lower and lower[0] else name
        hit = F.lit(False)
        for t in texts:
            hit = hit | c.contains(t)
        chain = F.when(hit, as_struct(label, key)) if chain is None else chain.when(hit, as_struct(label, key))
    return chain.otherwise(as_struct("Other", "other")) if chain is not None else as_struct("Other", "other")


def profile_name(name: Column, simplify: list, longest: int = 80) -> Column:
    """The name with the profile's replacements in order, cut to `longest` characters with ... at their end."""
    for old, new in simplify:
        name = F.replace(name, F.lit(old), F.lit(new))
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest - 3), F.lit("..."))).otherwise(name)


__all__ = ["category", "kernel_family", "module_label", "profile_category", "profile_name", "profile_of", "stripped", "submodule", "table_name"]
