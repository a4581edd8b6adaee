"""Fixed-width records, manifests, logs and the applications' inputs."""
