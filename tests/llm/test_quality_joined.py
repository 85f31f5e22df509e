"""Steps of the monotone fit are joined along the logistic curve."""

import numpy as np

from larkspur.llm.quality import joined


def test_steps_keep_their_heights_and_lines_follow_the_curve():
    places, heights = np.array([-40.0, -16.0, 4.0, 60.0]), np.array([0.02, 0.1, 0.98, 0.99])
    knots, values = joined(places, heights, 10.0)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    assert np.allclose(np.interp(places, knots, values), heights)
    curve = lambda at: 1 / (1 + np.exp(-(at + 10.0)))
    for at in np.linspace(-16, 4, 41):
        part = (curve(at) - curve(-16.0)) / (curve(4.0) - curve(-16.0))
        assert abs(np.interp(at, knots, values) - (0.1 + 0.88 * part)) < 0.01


def test_one_step_and_a_steep_curve():
    assert [x.tolist() for x in joined(np.array([3.0]), np.array([0.5]), 0.0)] == [[3.0], [0.5]]
    knots, values = joined(np.array([-5000.0, 5000.0]), np.array([0.1, 0.9]), 0.0)
    assert np.isfinite(values).all() and abs(np.interp(0.0, knots, values) - 0.5) < 0.01
