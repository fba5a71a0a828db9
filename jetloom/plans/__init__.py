"""End-to-end flows: preparation, training, inference and batched scoring."""
