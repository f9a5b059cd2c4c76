import hypothesis

hypothesis.settings.register_profile("small", max_examples=40, deadline=None)
hypothesis.settings.load_profile("small")
