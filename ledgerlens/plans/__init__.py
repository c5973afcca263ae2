"""Plan layer: view specs and signatures, end-to-end journal jobs, presets."""
