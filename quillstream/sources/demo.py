"""Bundled demo records, for trying the engine out and for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from quillstream.operators.records import normalize_papers

_FIELDS = ("source_id string, year int, title string, abstract string, authors array<string>, "
           "institutions array<string>, keywords array<string>, paper_url string, pdf_url string")

_URL = "https://openaccess.thecvf.com/"

# The two sample records.
_SAMPLES = [
    (None, 2024, "Vision Foundation Models for Open-Vocabulary Scene Understanding",
     "We study open-vocabulary scene understanding with large vision foundation models.",
     ["Alice Zhang", "Bob Wang"], ["Example University", "Display Lab"],
     ["foundation model", "open vocabulary", "scene understanding"], _URL, _URL),
    (None, 2023, "Efficient Video Representation Learning with Temporal Prompts",
     "This paper presents a temporal prompt strategy for efficient video representation learning.",
     ["Chen Li", "Dana Kim"], ["Institute of AI"],
     ["video", "representation learning", "prompt learning"], _URL, _URL),
]

# The eight demo records.
_DEMO = [
    ("cvpr-2024-vision-foundation-open-vocabulary-demo", 2024, "Vision Foundation Models for Open-Vocabulary Scene Understanding",
     "We study open-vocabulary scene understanding with large vision foundation models and evaluate transfer across detection and segmentation tasks.",
     ["Alice Zhang", "Bob Wang"], ["Example University", "Display Lab"],
     ["foundation model", "open vocabulary", "scene understanding", "semantic segmentation"], _URL, _URL),
    ("cvpr-2024-diffusion-video-generation-demo", 2024, "Controllable Diffusion Models for Long-Form Video Generation",
     "A controllable diffusion model is introduced for long-form video generation with temporal consistency and text-guided editing.",
     ["Chen Li", "Dana Kim"], ["Institute of AI"],
     ["diffusion model", "video understanding", "image generation"], _URL, _URL),
    ("cvpr-2023-efficient-video-prompt-demo", 2023, "Efficient Video Representation Learning with Temporal Prompts",
     "This paper presents a temporal prompt strategy for efficient video representation learning under limited annotation budgets.",
     ["Evan Zhou", "Fiona Chen"], ["Vision Systems Lab"],
     ["video understanding", "representation learning", "prompt learning"], _URL, _URL),
    ("cvpr-2023-3d-detection-autonomous-demo", 2023, "Robust 3D Object Detection for Autonomous Driving",
     "We improve 3D object detection robustness with multi-sensor fusion and uncertainty-aware proposal refinement.",
     ["Grace Liu", "Hao Sun"], ["Autonomous Intelligence Center"],
     ["3d detection", "object detection", "autonomous driving"], _URL, _URL),
    ("cvpr-2022-self-supervised-segmentation-demo", 2022, "Self-Supervised Semantic Segmentation with Masked Visual Tokens",
     "Masked visual token learning enables semantic segmentation models to learn dense visual representations without category-level annotation.",
     ["Iris Huang", "Jie Wu"], ["Machine Perception Lab"],
     ["self supervised", "semantic segmentation", "representation learning"], _URL, _URL),
    ("cvpr-2022-medical-image-foundation-demo", 2022, "Medical Image Foundation Models with Cross-Domain Adaptation",
     "A foundation model for medical image analysis is adapted across modalities with contrastive learning and domain adaptation.",
     ["Kai Zhao", "Lina Xu"], ["Medical AI Institute"],
     ["medical image", "foundation model", "domain adaptation"], _URL, _URL),
    ("cvpr-2021-pose-estimation-demo", 2021, "Human Pose Estimation via Graph-Aware Visual Transformers",
     "Graph-aware visual transformers improve human pose estimation by modeling long-range keypoint interactions.",
     ["Ming Tang", "Nora Yu"], ["Human-Centric Vision Lab"],
     ["pose estimation", "visual transformer"], _URL, _URL),
    ("cvpr-2021-few-shot-detection-demo", 2021, "Few-Shot Object Detection with Semantic Calibration",
     "Few-shot object detection benefits from semantic calibration between base and novel categories.",
     ["Oscar Lin", "Priya Rao"], ["Robust Learning Group"],
     ["few shot", "object detection"], _URL, _URL),
]


def sample_papers(spark: SparkSession, now: Column) -> DataFrame:
    return normalize_papers(spark.createDataFrame(_SAMPLES, _FIELDS), now)


def demo_papers(spark: SparkSession, now: Column) -> DataFrame:
    return normalize_papers(spark.createDataFrame(_DEMO, _FIELDS), now)
