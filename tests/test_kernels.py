import numpy as np
import pytest

from trialforge.kernels import signal, special
from trialforge.operators.comparison import mask_runs, max_mass


def test_f_tails_match_published_values():
    for f, a, b, p in [(1.203699, 1, 18, 0.287045), (9.251173, 1, 9, 0.013982), (7.490630, 1, 8, 0.025571), (8.815984, 1, 8, 0.017894), (0.576626, 1, 8, 0.469420)]:
        assert special.f_upper(f, a, b) == pytest.approx(p, abs=2e-6)


def test_t_tail_and_inverse():
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_critical(0.05, 10) == pytest.approx(2.228138852, abs=1e-7)


def test_lowpass_keeps_slow_and_stops_fast():
    t = np.arange(0, 20, 0.01)
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 20 * t)
    y = signal.lowpass(slow + fast, 100.0, 3.0, 4)
    assert np.abs(y - slow)[200:-200].max() < 0.01
    edge = np.sin(2 * np.pi * 3 * t)
    assert np.abs(signal.lowpass(edge, 100.0, 3.0, 4)[500:-500]).max() == pytest.approx(0.5, abs=0.01)  # -3 dB a pass
    assert np.allclose(signal.lowpass(np.full(50, 7.0), 100.0), 7.0)
    assert signal.lowpass(fast, 100.0, None) is fast


def test_irls_ignores_outliers_and_tends_to_ols():
    rng = np.random.default_rng(0)
    x = np.arange(100.0)
    y = 2 + 3 * x + rng.normal(0, 0.1, 100)
    bad = y.copy()
    bad[::10] += 500
    assert signal.irls(bad, x)[1] == pytest.approx([2, 3], abs=0.1)
    assert signal.irls(y, x, c=1e9)[1] == pytest.approx(np.polyfit(x, y, 1)[::-1], abs=1e-6)


def test_pchip_repairs_a_ramp():
    y = np.arange(12.0)
    broken = y.copy()
    broken[5:7] = 100
    assert np.abs(signal.fill(broken, np.arange(12.0), 5, 7, 3, 3) - y).max() < 1e-6


def test_masks_and_masses():
    assert mask_runs(np.array([0, 1, 1, 0, 1, 0], bool)) == [(1, 3), (4, 5)]
    a, b = np.random.default_rng(1).normal(size=(6, 5)), np.random.default_rng(2).normal(size=(6, 5))
    a[:, 2:4] += 50
    assert max_mass(a, b, 5.0) > 10
